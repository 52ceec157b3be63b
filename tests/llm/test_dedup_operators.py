"""Operators 4, 5 and 9 and connected components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import components, embedding_dedup, jaccard_join, substring_dedup

SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def union(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)]
    rows = [*links, (7, 7), (None, 3), (900, 900)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    want = union({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: want[k] for k in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize(("cell", "chunk"), [(4096, 2048), (10, 7)])
def test_embeddings(spark, cell, chunk):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = [(centres[k % 6] + rng.normal(size=8) * [0.02, 0.2, 0.5][k % 3]).astype(np.float32).tolist() for k in range(150)]
    rows = [(k, v, k % 2) for k, v in enumerate(vectors)]
    rows += [(200, vectors[0], 0), (201, vectors[0], 1), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 0), (205, [None] + vectors[0][1:], 0), (206, vectors[0], None), (207, [], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [float("inf")] * 8, 0), (211, [x * 1e-30 for x in vectors[0]], 0), (None, vectors[0], 0)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, dim int, weight string")
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(df, cell=cell, chunk=chunk).collect()}
    good = {i: np.array(v, np.float64) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}

    def near(a, b):
        x, y = good[a], good[b]
        return label[a] == label[b] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93

    links = [(a, b) for a in good for b in good if a < b and near(a, b)]
    want = union([r[0] for r in rows if r[0] is not None], links)
    for i, r in got.items():
        assert r.n_links == sum(i in p for p in links) if i is not None else r.n_links == 0
        assert (r.component_id, r.kept) == ((want[i], want[i] == i) if i is not None else (None, False))
    assert len(got) == len(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_near_dedup(empty).count() == 0


def test_embeddings_of_one_large_label(spark):
    """50,000 vectors of one label: several pivots and chunks, links known by construction."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(25_000, 24))
    both = np.concatenate([base, base + rng.normal(size=base.shape) * 0.01]).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(both)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_near_dedup(rows).toPandas().set_index("vec_id")
    x = both.astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    for k in range(0, 50_000, 997):
        assert got.n_links[k] == (x @ x[k] >= 0.93).sum() - 1 >= 1
        assert got.component_id[k] <= k % 25_000


def _linked(x):
    """n_links and components of unit vectors, by brute force."""
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    return near.sum(1), union(range(len(x)), zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


@pytest.mark.parametrize("most_copies", [0, 2, 1e9])
def test_embeddings_do_not_depend_on_cells(spark, most_copies):
    """Clustered and random vectors of one label, with no cells but one, with a bound on copies and without."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 900)] + rng.normal(size=(900, 16)) * rng.choice([0.02, 0.3, 0.6], (900, 1)), rng.normal(size=(300, 16))])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links, low = _linked(x)
    got = embedding_dedup.embedding_near_dedup(rows, chunk=100, most_copies=most_copies).toPandas().set_index("vec_id").sort_index()
    assert got.n_links.tolist() == links.tolist() and got.component_id.tolist() == [low[k] for k in range(len(x))]


def test_cells_save_comparisons(spark):
    """Tight clusters: at least 20 cells, far fewer pairs than all; without structure copies stay bounded, and no pair is compared twice."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 32))
    tight = centres[np.arange(4096) % 64] + rng.normal(size=(4096, 32)) * 0.05
    loose = rng.normal(size=(4096, 64))
    for x, label in ((tight, "tight"), (loose, "loose")):
        rows = spark.createDataFrame([(k, v.tolist(), label) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
        plan = embedding_dedup.metric_plan(rows).collect()
        assert [r.label for r in plan] == [label] and plan[0].vectors == 4096
        every = 4096 * 4095 // 2
        assert plan[0].copies <= 2 * 4096 and plan[0].pairs <= every
        if label == "tight":
            assert plan[0].cells >= 20 and plan[0].pairs < every / 10
    assert embedding_dedup.metric_plan(rows.limit(0)).count() == 0


def removed(rows, width):
    """(words, covered) of each document, windows judged on the input."""
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = SPACED.findall(t or "")
        cover = [False] * len(w)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if first.setdefault(g, (i, k)) != (i, k):
                cover[k : k + width] = [True] * width
        out[i] = (w, cover)
    return out


@pytest.mark.parametrize(("width", "kmer", "hot"), [(20, 5, 16), (6, 3, 2), (3, 3, 2)])
def test_substring_dedup(spark, documents, frame, monkeypatch, width, kmer, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(7)
    words = ["a", "b", "c", "Dd", "é"]
    passage = " ".join(rng.choice(words) + str(k) for k in range(40))
    rows = documents + [(50_000 + k, " ".join(rng.choice(words) for _ in range(40))) for k in range(60)] + [(60_000 + k, f"x{k} y{k} {passage} z{k}\n{passage}") for k in range(40)] + [(70_000, "same " * 200)]
    want = removed(rows, width)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup_digests(frame(rows), width, kmer).collect()}
    texts = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(rows), width, kmer).collect()}
    assert len(got) == len(texts) == len(rows)
    for i, t in rows:
        w, cover = want[i]
        kept = " ".join(x for x, c in zip(w, cover) if not c)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest())
        assert texts[i].text == (kept if any(cover) else t) and texts[i].bucket == 1


def test_substring_dedup_edges(frame):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup_digests(frame(rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]
    assert substring_dedup.substring_dedup_digests(frame([])).count() == 0 and substring_dedup.substring_dedup(frame([])).count() == 0
    a, b = (" ".join(f"{c}{k}" for k in range(70)) for c in "ab")
    mixed = substring_dedup.substring_dedup_digests(frame([(1, a), (1, b), (2, f"{a} {b}"), (3, f"x {b} y"), (3, b[:40])])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in mixed) == [(1, 70, 0), (1, 70, 0), (2, 140, 140), (3, len(b[:40].split()), 0), (3, 72, 70)]
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup_digests(frame([]), 50, 5)


def shingles(t):
    w = PLAIN.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w) or t] if t else [])


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_join(documents, frame, block):
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = list(documents)
    for k in range(40):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(120)] = f"n{rng.random()}"
        rows.append((50_000 + k, " ".join(words)))
    rows += [(60_000, "!!!"), (60_001, "!!!"), (60_002, "a b"), (60_003, "A  b."), (60_004, "a c")]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(rows), block=block).collect()}
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i, s in sets.items() if s]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a]) * 5 >= 4 * len(sets[b]) and len(sets[b]) * 5 >= 4 * len(sets[a]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want, count = union(sets, links), {}
    for p in links:
        for x in p:
            count[x] = count.get(x, 0) + 1
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count.get(i, 0), want[i], want[i] == i)
        assert got[i].class_id == min([i, *[j for j in ids if sets[j] == sets[i] and sets[i]]])


def test_jaccard_join_edges(frame):
    got = [(r.doc_id, r.n_links, r.kept) for r in jaccard_join.jaccard_join(frame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()]
    assert sorted(got, key=str) == [(1, 1, True), (1, 1, True), (2, 0, True), (None, 0, False)]
    assert jaccard_join.jaccard_join(frame([])).count() == 0


def test_pruning_tolerance():
    """Pairs at the threshold hardly ever go; pairs far below it go at once."""
    least = jaccard_join.least_matches(160, 20, 0.8, 1e-7)
    assert list(least) == sorted(least) and least[0] >= 2
    rng = np.random.default_rng(1)
    for s, survive in ((0.8, 1.0), (0.3, 0.0)):
        same = rng.random((4000, 160)) < s
        a = np.where(same, 1, 2).astype(np.uint32)
        sig = np.concatenate([np.ones((1, 160), np.uint32), a])
        left, _ = jaccard_join.survivors(sig, np.zeros(4000, np.int64), np.arange(1, 4001), 0.8, 1e-7)
        assert len(left) / 4000 == pytest.approx(survive, abs=0.001)


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 100).astype(np.uint64)) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    want = [len(set(sets[i]) & set(sets[j])) for i, j in zip(left, right)]
    assert list(jaccard_join.overlaps(sets, left, right)) == want and list(jaccard_join.overlaps(sets, left[:9], right[:9])) == want[:9]


def test_links_do_not_depend_on_the_block(spark):
    """Pairs count if they share a band, in components of any size and blocks of any size; few bands, so that some don't."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randint(0, 40)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(tuple(r) for r in jaccard_join.jaccard_join(docs, n_bands=2, rows=20, block=b).collect()) for b in (512, 40, 7)]
    assert found[0] == found[1] == found[2]
    assert 0 < sum(r[2] for r in found[0]) < sum(r.n_links for r in jaccard_join.jaccard_join(docs).collect())


def test_more_buckets_than_allowed(spark, documents, frame):
    """A table of texts never asks for more buckets than Spark allows."""
    want = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup_digests(frame(documents)).collect())
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "2")
    try:
        assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup_digests(frame(documents)).collect()) == want
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
