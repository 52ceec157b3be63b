"""Kernels of token sequences against the tables of the textbook."""

import random
import time

from pyspark.sql import functions as F

from tessera.functions import sequences, similarity


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def subsequence(a, b):
    t, i, j, out = table(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out, i, j = [a[i - 1], *out], i - 1, j - 1
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def run(a, b):
    best = (0, 0)
    for i in range(len(a)):
        for n in range(len(a) - i, best[1], -1):
            if any(b[k : k + n] == a[i : i + n] for k in range(len(b) - n + 1)):
                best = (i, n)
                break
    return best


def test_kernels_against_tables():
    rng = random.Random(3)
    for k in range(2000):
        a, b = ([rng.choice("abcd"[: 2 + k % 3]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert sequences.subsequence(a, b) == subsequence(a, b) and sequences.subsequence_length(a, b) == table(a, b)[-1][-1]
        assert sequences.edits(a, b) == edits(a, b) and sequences.common_run(a, b) == run(a, b)
    a, b = ([rng.choice("abcdefgh") for _ in range(300)] for _ in range(2))  # more than a machine word
    assert sequences.subsequence(a, b) == subsequence(a, b) and sequences.edits(a, b) == edits(a, b) and sequences.common_run(a, b) == run(a, b)


def test_long_pairs_take_milliseconds():
    rng = random.Random(4)
    a, b = ([f"w{rng.randint(0, 30)}" for _ in range(1000)] for _ in range(2))
    for f in (sequences.subsequence_length, sequences.subsequence, sequences.edits, sequences.common_run):
        f(a, b)
        began = time.perf_counter()
        for _ in range(5):
            f(a, b)
        assert (time.perf_counter() - began) / 5 < 0.05


def test_columns(spark):
    rows = [(["a", "b"], ["b", "c"]), (None, ["a"]), ([], None), (["x", None], [None, "x"]), (["a"] * 3, ["a"] * 2)]
    a, b = F.col("a"), F.col("b")
    found = spark.createDataFrame(rows, "a array<string>, b array<string>").select(similarity.edit_distance(a, b), similarity.common_subsequence_length(a, b), similarity.common_subsequence(a, b), similarity.common_run(a, b)).collect()
    assert [tuple(r) for r in found] == [(2, 1, ["b"], ["b"]), (1, 0, [], []), (0, 0, [], []), (2, 1, [None], ["x"]), (1, 2, ["a", "a"], ["a", "a"])]
