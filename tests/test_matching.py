"""Matching of lines and templates: against the lazy pattern on random pairs, in linear time, by join keys."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import match
from tessera.functions.text import token_count
from tessera.operators import cluster, matching, ranks


def lazily(line, template):
    """(covered, parameters) by one regular expression with lazy wildcards."""
    if "<*>" not in template:
        return line == template, []
    p = re.sub(r"([^A-Za-z0-9])", r"\\\1", re.sub(r"<.{1,5}>", "<*>", template))
    m = re.match("^" + re.sub(r"\\ +", r"\\s+", p).replace(r"\<\*\>", "(.*?)") + "$", line, re.ASCII)
    return m is not None, list(m.groups()) if m else []


def some_pairs(seed, n):
    """Lines made from their templates, some changed, with white space of all lengths, and unrelated ones."""
    rng = random.Random(seed)
    for k in range(n):
        letters = ["a", "b", "c", " ", " ", "  ", "."] if k % 2 else ["a", "b", " ", "ab", "-"]
        odd = (["\t"] if k % 10 == 0 else []) + (["\\", "s+", "$1", "<id>"] if k % 7 == 0 else [])
        template = "".join(rng.choice([*letters, *odd, "<*>", "<*>", "<*> ", " <*> "]) for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.75:
            line = "".join(rng.choice(["", "a", "b", "ab", " ", "a b", "  "]) if x == "<*>" else x if x != " " else " " * rng.randint(1, 3) for x in re.split(r"(<\*>| )", template))
            if rng.random() < 0.3 and line:
                i = rng.randrange(len(line))
                line = line[:i] + rng.choice("ab ") + line[i + 1 :]
        else:
            line = "".join(rng.choice(letters) for _ in range(rng.randint(0, 10)))
        yield k, line + "\n" * (k % 50 == 0) if k % 60 else line.replace(" ", "\n", 1), template


def test_matching_against_lazy_pattern(spark):
    pairs = list(some_pairs(1, 12_000)) + [(-1, None, "<*>"), (-2, "", "<*>"), (-3, "x", None), (-4, "a\x01b c", "a<*> c")]
    df = spark.createDataFrame(pairs, "k int, line string, t string")
    got = {r.k: (r.m, r.p) for r in df.select("k", match.matches(F.col("line"), F.col("t")).alias("m"), match.parameters(F.col("line"), F.col("t")).alias("p")).collect()}
    assert got == {k: lazily(line or "", t or "") for k, line, t in pairs}
    assert sum(m for m, _ in got.values()) > 6000


@pytest.mark.parametrize("wildcards, length", [(50, 10_000), (50, 400_000), (5, 243)])
def test_failing_line_costs_its_length(spark, wildcards, length):
    template, line = " ".join(["x <*>"] * wildcards) + " end", "x a " * (length // 4)
    df = spark.createDataFrame([(line + "fin", line + "end", template)], "bad string, good string, t string").cache()
    df.count()
    asked = df.select(match.matches(F.col("bad"), F.col("t")).alias("bad"), F.size(match.parameters(F.col("good"), F.col("t"))).alias("n"))
    asked.collect()  # compiles
    began = time.perf_counter()
    assert tuple(asked.first()) == (False, wildcards)
    assert time.perf_counter() - began < 3


def test_end_tokens_are_join_keys(spark):
    rng = random.Random(4)
    words = ["a", "b", "x<*>", "<*>", "c", "="]
    templates = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)}) + ["", " "]
    texts = [" ".join(rng.choice(["a", "b", "c", "x1", "*", "="]) for _ in range(rng.randint(0, 4))) for _ in range(200)] + [None, " a  b "]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, content string").withColumn("n_tokens", token_count(F.col("content"))).withColumn("ends", F.lit(1)).withColumn("shape", F.lit(2))
    known = spark.createDataFrame([(t, "w") for t in templates], "template string, words string").withColumn("n_tokens", token_count(F.col("template")))
    found = matching.match_templates(lines, known)
    assert found.columns == ["n_tokens", "line_id", "content", "ends", "shape", "template", "words"]

    def fits(x, t):
        a, b = (x or "").split(), t.split()
        return bool(a) and len(a) == len(b) and all("<*>" in b[k] or a[k] == b[k] for k in (0, -1)) and lazily(x, t)[0]

    assert {(r.line_id, r.template) for r in found.collect()} == {(k, t) for k, x in enumerate(texts) for t in templates if fits(x, t)}
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        plan = matching.match_templates(lines, known)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Join \[n_tokens#\d+, ends_#\d+\], \[n_tokens#\d+, ends_#\d+\]", plan)


def test_corrections_of_any_columns(spark):
    lines = spark.createDataFrame([(1, "E10", "user root in", "mine", 7)], "line_id long, event_id string, template string, own string, new int")
    fixed = matching.apply_corrections(lines, matching.correct_templates(spark.createDataFrame([("E10", "user root in"), ("E2", "user admin in")], "event_id string, template string")))
    assert [tuple(r) for r in fixed.collect()] == [(1, "E2", "user <*> in", "mine", 7)] and fixed.columns == lines.columns


def test_ordinals(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 50), f"k{k}", None if k % 11 else k) for k in range(700)]
    df = spark.createDataFrame(rows, "range int, key string, begin int")
    got = {r.key: r.place for r in ranks.ordinals(df, ["range", "key"], "place").collect()}
    assert got == {key: k for k, (_, key, _) in enumerate(sorted(rows, key=lambda r: r[:2]))}
    assert ranks.ordinals(df.limit(0), ["range"], "place").count() == 0
    labelled = df.select(F.col("key").alias("template"), F.monotonically_increasing_id().alias("line_id"))
    bucketed = cluster.length_buckets(df.select(F.col("key").alias("content")))
    for made in (matching.event_ids(labelled), bucketed):
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", made._jdf.queryExecution().optimizedPlan().toString())
        assert all(w.startswith("range") for w in windows if w) and len(windows) == 2


def test_first_template_against_all_matches(spark):
    rng = random.Random(9)
    words = ["a", "b", "<*>", "a<*>", "<id>", "<a b>", "c.d", "x"]
    texts = sorted({" ".join(rng.choice(words[:2] + ["axb", "c.d", "x", "<id>"]) for _ in range(rng.randint(1, 4))) for _ in range(300)}) + ["", " a  b ", "a\tb", "a\nb"]
    shapes = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(80)}) + [" ", ""]
    lines = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "line_id long, cid1 int, content string")
    templates = spark.createDataFrame([(0, rng.randint(0, 9), t) for t in shapes], "cid1 int, rank int, template string")
    want = {r.line_id: (r.b.rank, r.b.template) for r in matching.match_templates(lines, templates, ("cid1",)).groupBy("line_id").agg(F.min(F.struct("rank", "template")).alias("b")).collect()}
    got = matching.first_template(lines, templates, "rank")
    assert len(want) > 50 and {r.line_id: r.found and (r.found.rank, r.found.template) for r in got.collect()} == {k: want.get(k) for k in range(len(texts))}
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()  # lines stay where they are


def test_signatures_by_any_list_of_frequent_tokens(spark):
    rng = random.Random(10)
    texts = sorted({" ".join(f"tok{min(rng.randint(0, 12), rng.randint(0, 12))}" for _ in range(rng.randint(0, 6))) for _ in range(200)})
    bucketed = cluster.length_buckets(cluster.distinct_lines(spark.createDataFrame(list(enumerate(texts)), "line_id long, content string"))).cache()
    counts = {}
    for r in bucketed.collect():
        for t in r.content.split():
            counts[r.cid1, t] = counts.get((r.cid1, t), 0) + r.weight
    want = {r.first_line: sorted(dict.fromkeys(r.content.split()), key=lambda t: -counts[r.cid1, t])[:3] for r in bucketed.collect()}
    for listed in (0, 2, 9, 1024):
        assert {r.first_line: r.sig for r in cluster.signatures(bucketed, 3, listed).collect()} == want
