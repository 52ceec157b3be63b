"""Mining on a stream against mining of all lines at once."""

import random

from tessera.operators import mine
from tessera.streaming import mining

SHAPES = ["user {} logged in from {}", "disk {} of host {} is", "service started again"]


def some_lines(n):
    rng = random.Random(2)
    truth = [rng.choice(SHAPES) for _ in range(n)]
    return truth, [(k, t.format(*[f"v{rng.randint(1, 999)}" for _ in range(t.count("{}"))])) for k, t in enumerate(truth)]


def test_ten_batches_end_as_one(spark, tmp_path):
    truth, rows = some_lines(200)
    for k in range(10):
        spark.createDataFrame(rows[k::10], "line_id long, content string").coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    stream = spark.readStream.schema("line_id long, content string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = mining.start_mining(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state", min_size=5)
    assert query.awaitTermination(300) and query.exception() is None
    lines, entries = mining.mined_lines(spark, f"file://{tmp_path}/out", 9)
    got = {r.line_id: r.template for r in lines.collect()}
    whole = {r.line_id: r.template for r in mine.mine_templates(spark.createDataFrame(rows, "line_id long, content string"), min_size=5).collect()}
    assert got == whole and set(got) == set(range(200)) and set(got.values()) == {s.replace("{}", "<*>") for s in SHAPES}
    found = entries.collect()
    assert len({(r.n_tokens, r.entry) for r in found}) == len(found) and all((r.root == r.entry) == (r.parent is None) for r in found)


def test_lines_wait_and_batches_repeat(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    batches = [[(0, "lonely line"), (1, "a b1 c"), (2, "a b2 c"), (3, None)], [(4, "a b3 c")], [(5, "x y1 z of"), (6, "x y2 z of")], []]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "line_id long, content string")
        for _ in range(2 if number == 1 else 1):  # a batch that runs again leaves the same
            mining.mine_batch(df, number, path, least=2, patience=3, min_size=1)
        lines, _ = mining.mined_lines(spark, path, number)
        seen = {r.line_id: r.template for r in lines.collect()}
        assert (0 in seen) == (number == 3)
    assert seen == {0: "lonely line", 1: "a <*> c", 2: "a <*> c", 3: "", 4: "a <*> c", 5: "x <*> z of", 6: "x <*> z of"}


def test_forest_of_merges(spark):
    rows = [(1, k, f"t{k}", k, k - 1 if k % 5 else None) for k in range(20)] + [(2, 3, "other", 0, None)]
    found = {(r.cid1, r.entry): (r.parent, r.root, r.root_template) for r in mine.merge_forest(spark.createDataFrame(rows, "cid1 int, entry long, template string, round int, replaces long")).collect()}
    assert found == {(1, k): (k + 1 if k % 5 < 4 else None, k // 5 * 5 + 4, f"t{k // 5 * 5 + 4}") for k in range(20)} | {(2, 3): (None, 3, "other")}
    assert mine.merge_forest(spark.createDataFrame([], "cid1 int, entry long, template string, round int, replaces long")).count() == 0
