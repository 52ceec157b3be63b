"""Samples of any size, similar lines, measures of slices and lineage of merges against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, mine, sampling, similar


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b)


def best_of_all(lines, size):
    """The first combination of lowest score; all lines where there are fewer."""
    if len(lines) < size - 1:
        return [x for _, x in lines], None
    found = []
    for chosen in itertools.combinations(range(len(lines)), size - 1):
        v = sorted([lines[i][0] for i in chosen] + [jaccard(lines[i][1], lines[j][1]) for i, j in itertools.combinations(chosen, 2)])
        apart = [abs(x - y) for x, y in itertools.combinations(v, 2)] or [0.0]
        found.append((round(0.6 * sum(v) / len(v) + 0.4 * sum(apart) / len(apart), 9), chosen))
    score, chosen = min(found)
    return [lines[i][1] for i in chosen], score


def test_samples_against_all_combinations(spark):
    rng, rows = random.Random(5), []
    for c, n in enumerate((9, 7, 2, 11)):
        base = [f"t{rng.randint(0, 9)}" for _ in range(6)]
        for i in range(n):
            words = [f"v{rng.randint(0, 5)}" if rng.random() < 0.3 else w for w in base]
            rows.append((c, " ".join(base), " ".join(words), jaccard(" ".join(base), " ".join(words)), 0, c * 100 + i))
    pool = spark.createDataFrame(rows, "cid2 int, anchor string, content string, sim double, sig_first int, first_line int").cache()
    for size in (2, 3, 5):
        got = {r.cid2: (r.lines, r.score) for r in sampling.best_samples(pool, size).collect()}
        assert got == {c: best_of_all([(r[3], r[2]) for r in rows if r[0] == c], size) for c in range(4)}
    with pytest.raises(ValueError):
        sampling.best_samples(pool, 1)


def test_mining_with_other_samples(spark):
    lines = spark.createDataFrame([(k, f"job {k} of queue {k % 7} on host{k} took {k * 3} ms") for k in range(40)], "line_id long, content string")
    labelled, trace = mine.mine_with_trace(lines, **mine.Settings(min_size=5, sample_size=4, min_similarity=0.2, weight=0.3, per_level=5).options())
    assert {r.template for r in labelled.collect()} == {"job <*> of queue <*> on <*> took <*> ms"} and len(trace.first().sample) == 4


def test_similar_lines_against_all_pairs(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["hot"] * 5 + [f"w{k}" for k in range(30)]) for _ in range(rng.randint(0, 9))) for _ in range(400)] + [None, "  ", "hot", "hot hot"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, content string")
    sets = {}
    for k, t in enumerate(texts):
        if t and t.split():
            sets.setdefault(frozenset(t.split()), k)
    for threshold, listed in ((0.5, 3), (0.75, 4096), (1.0, 1)):
        got = {(r.a, r.b): (r.common, pytest.approx(r.sim)) for r in similar.similar_lines(lines, threshold, listed).collect()}
        assert got == {(i, j): (len(p & q), len(p & q) / len(p | q)) for p, i in sets.items() for q, j in sets.items() if i < j and len(p & q) / len(p | q) >= threshold}
    with pytest.raises(ValueError):
        similar.similar_lines(lines, 0.0)


def test_no_group_of_a_frequent_token(spark):
    """A token of every line is a join key of no line that holds enough others."""
    lines = spark.createDataFrame([(k, f"always here a{k} b{k % 50} c{k % 70} d{k}") for k in range(600)], "line_id long, content string")
    keys = similar.prefixes(similar.token_sets(lines), 0.8)
    assert keys.where(F.col("token").isin("always", "here")).count() == 0
    assert keys.groupBy("small", "large", "token").count().agg(F.max("count")).first()[0] <= 12


def test_slices_in_one_pass(spark):
    rng = random.Random(7)
    rows = [(k, g := rng.choice(["a", "b <*>", "c <*> <*>", "d <*> <*> <*> <*> <*>", "e"]), g if rng.random() < 0.7 else rng.choice("axy")) for k in range(200)]
    table = evaluate.contingency(spark.createDataFrame(rows, "line_id long, gt string, parsed string")).cache()
    slices = {f"c{k}": evaluate.by_complexity(k) for k in (1, 2, 3)} | {f"f{p}": evaluate.by_frequency(p) for p in (40, -40, 100)} | {"none": F.lit(False)}
    got = {r.slice: tuple(r)[1:] for r in evaluate.metrics_of_slices(table, slices).collect()}
    for name in slices:
        only = evaluate.of_complexity(table, int(name[1])) if name[0] == "c" else evaluate.of_frequency(table, int(name[1:])) if name[0] == "f" else table.limit(0)
        assert got[name] == pytest.approx(tuple(evaluate.metrics(table, only).first()))
    plan = evaluate.metrics_of_slices(table, slices)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1


def test_lineage_of_merges(spark):
    """Values that look constant in their clusters merge, one cluster a round; entries say what has become of what."""
    rows = [(k, f"pump{k % 4} x {k} on of it") for k in range(400)]
    labelled, trace, entries = mine.mine_with_lineage(spark.createDataFrame(rows, "line_id long, content string"), min_size=20)
    final = entries.where("entry = root").collect()
    assert [r.template for r in final] == ["<*> x <*> on of it"] and {r.root_template for r in entries.collect()} == {"<*> x <*> on of it"}
    assert sorted((r.round, r.template) for r in entries.collect())[0] == (0, "pump0 x <*> on of it")
    assert {(r.template, r.entry) for r in labelled.collect()} == {(final[0].template, final[0].entry)} and labelled.count() == 400 and trace.count() >= 2
