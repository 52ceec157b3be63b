"""Work that grows with a table's different rows, not with all: seen in the plans of the last steps."""

import random

import pytest

from tessera.operators import cluster, ranks, sampling, similar
from tessera.plans import corpora, queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_pairs_merge_once(spark):
    merged = queries.merge_pairs(spark, SF)
    assert "regexp" not in plan(merged) and "lambda" not in plan(merged)  # lines only look up what their pair has become
    assert merged.count() == corpora.template_pairs(spark, SF).count()


def test_neighbours_without_gathering_a_kind(spark):
    pairs = corpora.line_pairs(spark, SF)
    assert "hashpartitioning(event_type" not in plan(pairs) and "hashpartitioning(kind" not in plan(pairs)
    assert sorted(pairs.collect()) == sorted(corpora.view(spark, SF, "events", corpora.LINE_PAIRS).collect())


@pytest.mark.parametrize("size", (0, 1, 300))
def test_following_rows(spark, size):
    rng = random.Random(size)
    rows = [(k, rng.choice(["a"] * 9 + ["b", None]), rng.choice([None, f"v{k}"])) for k in range(size)]
    got = ranks.following(spark.createDataFrame(rows, "k long, g string, v string").repartition(5), "g", "k", "v", ("x", "y", "z")).collect()
    after = {k: [v for i, h, v in rows if h == g and i > k] + [None] * 3 for k, g, _ in rows}
    assert len(got) == size and {r.k: (r.x, r.y, r.z) for r in got} == {k: tuple(v[:3]) for k, v in after.items()}


def test_similar_pairs_are_not_dealt(spark):
    """Pairs are judged where they meet; blocks of any size give each pair once."""
    rng = random.Random(11)
    texts = sorted({" ".join(rng.choice(["hot", "cold"] + [f"w{k}" for k in range(6)]) for _ in range(rng.randint(1, 7))) for _ in range(300)})
    sets = similar.token_sets(spark.createDataFrame(list(enumerate(texts)), "line_id long, content string")).cache()
    held = [(r.set_id, set(r.words)) for r in sets.collect()]
    want = sorted((min(i, j), max(i, j), len(v & w)) for k, (i, v) in enumerate(held) for j, w in held[:k] if len(v & w) / len(v | w) >= 0.6)
    for block in (1, 7, 1 << 14):
        found = similar.similar_sets(sets, 0.6, block=block)
        assert want and sorted((r.a, r.b, r.common) for r in found.collect()) == want
        top = plan(found).split("SortMergeJoin")[0].split("HashJoin")[0]
        assert "Exchange" not in top and "HashAggregate" not in top


def test_lines_of_frequent_tokens_stay_whole(spark):
    lines = spark.createDataFrame([(k, f"worker {k} on node n{k % 3} is done") for k in range(300)], "line_id long, content string")
    signed = cluster.signatures(cluster.length_buckets(cluster.distinct_lines(lines)), listed=5)
    assert "Generate" not in plan(signed) and {tuple(r.sig) for r in signed.collect()} == {("worker", "node", "done")}


def test_similarity_of_a_line_is_computed_once(spark):
    clustered = cluster.cluster_lines(spark.createDataFrame([(k, f"worker {k} on node n{k % 3} is done") for k in range(300)], "line_id long, content string"))
    pool = sampling.candidate_pool(sampling.similarities(clustered, sampling.anchors(clustered)))
    assert pool.count() == 6 and pool._jdf.queryExecution().optimizedPlan().toString().count("array_union(") == 1
