"""Phrases, fill-in-middle and shards against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases, sharding
from tessera.llm.fill_in_middle import Sentinels, fill_in_middle, op12_fill_in_middle, restored

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_collocations(rows, top, most, least):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            count.update((lang, tuple(words[i : i + m])) for m in range(1, most + 1) for i in range(len(words) - m + 1))
    out = {}
    longer = [k for k, a in count.items() if len(k[1]) > 1 and a >= least]
    for lang, w in longer:
        a = count[lang, w]
        if any(x == lang and len(v) > len(w) and count[x, v] >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for x, v in longer):
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def some_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary, gaps = ["the", "The", "of", "a", "b", "c", "été", "x1", "日本", "hot", "hot", "rare"], [" ", " ", " ", "  ", "\t", ", ", "\n", ".", " "]

    def word():
        w = rng.choice(vocabulary)
        return f"{w}{rng.randint(0, 40)}" if w == "rare" else w

    texts = ["".join(word() + rng.choice(gaps) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", None), ("en", ""), ("fr", "  \n.,"), ("en", texts[0]), ("en", texts[0])] + [("de", "hot hot hot hot hot hot hot")] * 9


@pytest.mark.parametrize("split_rows, listed", [(1 << 17, 1 << 20), (7, 5)])
def test_collocations_against_counting(spark, split_rows, listed):
    """Also where pivots are dealt to several partitions and where hardly a word is listed."""
    rows = some_texts(3)
    docs = spark.createDataFrame([(t, lang, 1, 2, "x") for lang, t in rows], "text string, lang string, n int, pivot int, phrase string")
    got = {tuple(r) for r in phrases.collocations(docs, 30, 5, 4, listed=listed, split_rows=split_rows).collect()}
    assert got == naive_collocations(rows, 30, 5, 4) and len(got) > 60


def test_divided_pivots_send_no_rare_phrases(spark, monkeypatch):
    """Each phrase is counted in one place, whatever is divided: only frequent ones are kept, once each."""
    kept, keep = [], phrases.materialise
    monkeypatch.setattr(phrases, "materialise", lambda df: kept.append(keep(df)) or kept[-1])
    docs = spark.createDataFrame([(lang or "und", t) for lang, t in some_texts(3)], "lang string, text string")
    phrases.phrase_counts(docs, 5, 4, split_rows=7)
    found = [[(r.lang, r.phrase, r.n) for r in df.collect()] for df in kept if "phrase" in df.columns]
    assert found and all(len({x[:2] for x in rows}) == len(rows) > 100 and min(x[2] for x in rows) >= 4 for rows in found)


@pytest.mark.parametrize("held_rows", [400_000, 50])
def test_hot_runs_of_words_are_divided(spark, monkeypatch, held_rows):
    """No core has more places than the bound, but a run alone, which is one number: also for words that always stand together."""
    monkeypatch.setattr(phrases, "HELD_ROWS", held_rows)
    rng = random.Random(4)
    texts = [" ".join([*rng.choices("abcdefghi", k=4), "san francisco bay area", *rng.choices("abcdefghi", k=4), f"x{k % 50}, san francisco"]) for k in range(300)] + ["a a a a a a a a a", "b the b the b"] * 60
    rows, split = [("en", t) for t in texts] + [("de", "san francisco")] * 5, 40
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    words = phrases.word_counts(docs)
    rare = phrases.rarity(words, 4)
    known = spark.sparkContext.broadcast(rare)
    many = phrases.divided_runs(docs, known, words.agg(F.sum("n")).first()[0], 5, split)
    places, naive = Counter(), Counter()
    for r in phrases.fragments(docs, known, many, 5, split).collect():
        for line in r.fragments.split("\n"):
            core, left, right, *n = line.split("\t")
            naive.update({(r.lang, p): x for p, x in phrases._phrases_of(Counter([line]), 5).items()})
            if left or right:
                places[r.lang, core] += int(n[0]) if n else 1
    assert max(places.values()) <= split and {len(core.split()) for _, core in places} >= {1, 2, 3, 4}
    want = Counter()
    for lang, text in rows:
        for w in (piece.split() for piece in text.split(",")):
            want.update((lang, " ".join(w[i : i + m])) for m in range(2, 6) for i in range(len(w) - m + 1))
    assert {k: n for k, n in naive.items() if n >= 4} == {k: n for k, n in want.items() if n >= 4}
    assert {tuple(x) for x in phrases.mined(phrases.fragments(docs, known, many, 5, split), 5, 4).collect()} == {(*k, n) for k, n in want.items() if n >= 4}


def test_collocations_of_long_texts(monkeypatch):
    """A text is worked on in chunks that end anywhere between words: every phrase is counted once."""
    rng = random.Random(5)
    text = "".join(rng.choice(["aa", "b", "ccc"]) + rng.choice([" ", " ", " ", "  ", ", "]) for _ in range(4000)) + "w" * 3000
    for limit, around in ((64, 8), (1000, 8), (64, 0)):
        found = list(phrases.chunks(pa.array([text, "x y", None, text]), around, limit))
        own = [bytes(c.data[c.words.starts[k] : c.words.ends[k]]).decode() for c in found for k in range(c.begin, c.end)]
        assert own == (re.findall(r"[^ ,]+", text) + ["x", "y"] + re.findall(r"[^ ,]+", text))
    rows = [("en", text), ("en", text[:900])]
    monkeypatch.setattr(phrases.chunks, "__defaults__", (0, 200))
    assert len(list(phrases.chunks(pa.array([text]), 8))) > 20
    got = Counter()
    for c in phrases.chunks(pa.array([t for _, t in rows]), 8):
        each, where = np.unique(phrases._keys(c.words, np.zeros(len(c.row), np.uint64)), return_inverse=True)
        rank = np.arange(len(each))[where]
        follows = np.zeros(len(rank) + 1, bool)
        breaks = np.concatenate([[0], np.cumsum(phrases.BREAK[c.data])])
        follows[1 : len(rank)] = (breaks[c.words.starts[1:]] == breaks[c.words.ends[:-1]]) & (c.row[1:] == c.row[:-1])
        pivot = np.ones(len(rank), bool)
        pivot[: c.begin] = pivot[c.end :] = False
        left, right = phrases._context(rank, follows[:-1], pivot, 5)
        words = [bytes(phrases.LOWER[c.data[a:b]]).decode() for a, b in zip(c.words.starts, c.words.ends, strict=True)]
        for at in range(len(rank)):
            for i in range(left[at] + 1):
                for j in range(right[at] + 1):
                    if 1 <= i + j <= 4:
                        got[tuple(words[at - i : at + j + 1])] += 1
    want = Counter(tuple(w[i : i + m]) for _, t in rows for piece in t.split(",") for w in [piece.split()] for m in range(2, 6) for i in range(len(w) - m + 1))
    assert got == want


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], docs.schema)).count() == 0


def test_fill_in_middle_against_loop(spark, documents, frame):
    odd = [(20_000, "a <S> b"), (20_001, "<P"), (20_002, ">"), (20_003, "one line"), (20_004, "\n"), (20_005, "\n\n\n"), (20_006, "a\r\nb c\n<"), (20_007, "S>x\n<"), (3, "twice\nthe id"), (None, "no\nid\nhere"), (20_008, "x퟿\U0001f600\n" * 5000)]
    rows = documents + odd
    made = fill_in_middle(frame(rows), rate=80)
    found = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    forms = Counter()
    want = []
    for i, t in rows:
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = [int(x, 16) for x in re.findall("........", hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest())[:4]]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 80 else "spm" if h[3] % 100 < 50 else "psm"
        forms[form] += 1
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((str(i), t, len(units), form, *([None] * 3 if form == "plain" else [p, m, s]), out, t))
    assert sorted(map(repr, want)) == sorted(repr((str(r.doc_id), r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back)) for r in found)
    assert min(forms.values()) > 20 and len(forms) == 3
    assert fill_in_middle(frame([])).count() == 0


def test_sentinels(spark):
    for wrong in (("", "b", "c"), ("<P>", "<P>", "<M>"), ("<P>", "<P><", "|"), ("ab", "ca", "d")):
        with pytest.raises(ValueError):
            Sentinels(*wrong)
    own = Sentinels("[pre.", "␂mid*", "$")
    docs = spark.createDataFrame([(k, "a.b\n*mid[pr\ne.c$"[: k % 15] + "\n") for k in range(60)], "doc_id long, text string")
    rows = fill_in_middle(docs, sentinels=own).withColumn("back", restored(F.col("output"), F.col("form"), own)).collect()
    assert all(r.back == r.text for r in rows) and any(r.form != "plain" for r in rows)
    wrong = spark.createDataFrame([("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("a", "plain"), ("a", "other")], "o string, f string").select(restored(F.col("o"), F.col("f")).alias("t"))
    assert [r.t for r in wrong.collect()] == [None, None, "a", None]


def test_fill_in_middle_is_native(spark):
    plan = op12_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def shards_of(docs, shards, **options):
    rows = sharding.shuffled_shards(docs, shards, **options).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    return rows


@pytest.mark.parametrize("n, shards, bits", [(0, 8, 15), (5, 8, 1), (1003, 7, 6), (400, 64, 3), (50, 1, 15)])
def test_shards_are_exact(spark, n, shards, bits):
    docs = spark.createDataFrame([(k if k % 9 else None, None if k % 5 == 0 else "copy", k) for k in range(n)], "doc_id long, text string, shard int")
    named = docs.select("doc_id", "text", F.col("shard").alias("c0"), F.lit(1).alias("at"), F.lit(2).alias("source"), F.lit(3).alias("key"), F.lit(4).alias("run"))
    assert sorted(r.c0 for r in shards_of(named, shards, source_bits=bits, run_rows=3)) == list(range(n))


def test_shuffle_is_uniform(spark):
    """Every row is in every shard and place about as often; cells of the matrix have the hypergeometric mean and variance."""
    rows = [(s, 40 if s % 3 else 20) for s in range(300)]
    n = sum(x for _, x in rows)
    cells = {(r.source, r.shard): r.n for r in sharding.communication_matrix(spark.createDataFrame(rows, "source long, rows long"), 4).collect()}
    assert all(sum(cells.get((s, k), 0) for k in range(4)) == x for s, x in rows) and {sum(cells.get((s, k), 0) for s, _ in rows) for k in range(4)} == {n // 4}
    for size in (20, 40):
        drawn = np.array([[cells.get((s, k), 0) for k in range(4)] for s, x in rows if x == size])
        variance = size * (1 / 4) * (3 / 4) * (n - size) / (n - 1)
        assert abs(drawn.mean() - size / 4) < 0.2 and 0.85 * variance < drawn.var(0).mean() < 1.15 * variance
        assert -0.45 < np.corrcoef(drawn.T)[0, 1] < -0.2  # -1/3 by the law
    n, tries = 24, 40
    docs = spark.range(n * tries).repartition(3, "id")  # many small rows stand for many tries: each id's place is as likely as any
    rows = shards_of(docs.withColumnRenamed("id", "doc_id"), 4, source_bits=5, seed=9)
    third = Counter((r.doc_id // (n * tries // 3), r.shard) for r in rows)
    assert all(abs(c - n * tries / 12) < 5 * (n * tries / 12) ** 0.5 for c in third.values())
    slots = [r.slot for r in sorted(rows, key=lambda r: r.doc_id)]
    assert abs(np.corrcoef(slots, range(len(slots)))[0, 1]) < 0.13
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled_shards(docs.withColumnRenamed("id", "doc_id"), 4, seed=10).collect()}
    assert sum(other[r.doc_id] == (r.shard, r.slot) for r in rows) < 30


def test_written_shards_and_query(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id long, text string")
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4, files=2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 200 and {r["count"] for r in back.groupBy("shard").count().collect()} == {50}
    rows = sharding.op13_shuffled_shards(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
    plan = sharding.op13_shuffled_shards(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
