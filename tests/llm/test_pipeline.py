"""Every stage of the pipeline against its own input, and the whole."""

import re

import corpus_pipeline
from tessera.llm.kernels import materialise, table
from tests.llm.test_dedup_operators import removed, shingles, union

SF = "/root/testdata/sf0.001"
#: Letters that no language of the documents explains.
NOISE = " ".join("".join("bcdfgjkqvwxz"[(7 * k + 5 * j * j + k * j) % 12] for j in range(7)) for k in range(40))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    noise = spark.createDataFrame([(10_000_000 + k, t, None, "noise", len(t)) for k, t in enumerate([NOISE, "鼈麤龘 " * 30, "1 2 3 ...", ""])], docs.schema)
    docs = docs.unionByName(noise)
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect() if r.source != "noise"}
    (_, language), (_, near), (_, passages), (_, pack) = corpus_pipeline.STAGES

    kept = materialise(language(spark, docs, SF))
    after = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(after) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}  # a letter test would keep two rows of noise
    assert all(after[i] == before[i] for i in after)

    unique = materialise(near(spark, kept, SF))
    sets = {i: shingles(r.text) for i, r in after.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8]
    root = union(sets, links)
    left = {r.doc_id: r for r in unique.collect()}
    assert unique.columns == columns and set(left) == {i for i in sets if root[i] == i} and len(left) < len(after)

    cut = materialise(passages(spark, unique, SF))
    assert cut.columns == columns
    want = removed([(i, r.text) for i, r in left.items()], 20)
    touched = 0
    for r in cut.collect():
        words, cover = want[r.doc_id]
        text = " ".join(w for w, c in zip(words, cover) if not c) if any(cover) else left[r.doc_id].text
        touched += any(cover)
        assert r.text == text and r.n_chars == len(text)
    assert touched and cut.count() == len(left)

    packed = pack(spark, cut, SF).toPandas()
    assert set(packed.doc_id) == set(left)


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 and len(packed) > 100


def test_repeated_and_missing_ids(spark):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(60))

    rows = [(5, text(0)), (5, text(0)), (None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (3, text(3) + " end"), (None, text(4)), (9, text(5)), (8, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(5, text(0)), (None, text(1)), (7, text(2)), (3, text(3) + " end"), (None, text(4)), (8, text(5))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
