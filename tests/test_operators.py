"""Operators on small tables: clustering against a loop, sampling, mining, evaluation, readers and writers."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, token_count
from tessera.operators import cluster, evaluate, matching, mine, sampling
from tessera.plans.oracles import ORACLE_SQL
from tessera.plans.queries import QUERIES
from tessera.sources import logs, presets, sinks


def lines_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, content string")


def naive_clusters(texts, k, least):
    """The clusters of one loop over lengths, prefixes and lines: sets of line numbers, in order."""
    out = []
    for n in sorted({len(t.split()) for t in texts}):
        rows = [i for i, t in enumerate(texts) if len(t.split()) == n]
        kept = {i: [w for w in texts[i].split() if len(w) > 2 and w not in STOP_WORDS] for i in rows}
        count = Counter(w for i in rows for w in kept[i])
        sig = {i: tuple(sorted(dict.fromkeys(kept[i]), key=lambda w: -count[w])[:k]) for i in rows}
        pending = list(rows)
        for level in range(k, 0, -1):
            groups = {}
            for i in pending:
                groups.setdefault(sig[i][:level], []).append(i)
            for group in sorted((g for g in groups.values() if len(g) >= least), key=min):
                out.append(set(group))
                pending = [i for i in pending if i not in out[-1]]
        if pending:
            out.append(set(pending))
    return out


def test_clusters_against_loop(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    clustered = cluster.cluster_lines(lines_of(spark, texts), 3, 12).select("content", "cid2").collect()
    number = {r.content: r.cid2 for r in clustered}
    got = {}
    for i, t in enumerate(texts):
        got.setdefault(number[t], set()).add(i)
    assert [got[k] for k in sorted(got)] == naive_clusters(texts, 3, 12)


def test_empty_and_null_lines(spark):
    empty = spark.createDataFrame([], "line_id long, content string")
    assert cluster.cluster_lines(empty).count() == 0
    assert mine.mine_templates(empty).count() == 0
    mined = {r.line_id: r for r in mine.mine_templates(lines_of(spark, [None, "", "one", "one", "<*> " * 51 + "x"]), min_size=1).collect()}
    assert mined[0].template == mined[1].template == "" and mined[2].template == mined[3].template == "one" and mined[4].template.endswith("x")
    assert mined[0].event_id == "E1"
    with pytest.raises(ValueError):
        cluster.signatures(empty, 0)


def test_mining_round_trip(spark):
    rng = random.Random(2)
    shapes = ["user {} logged in from {}", "disk {} is full now", "retry {} of job {} failed with code {}", "service started"]
    truth = [rng.choice(shapes) for _ in range(400)]
    texts = [t.format(*[f"v{rng.randint(1, 999)}" for _ in range(t.count("{}"))]) for t in truth]
    mined = mine.mine_templates(lines_of(spark, texts), min_size=5).collect()
    assert len(mined) == 400
    by_truth = {t: {r.template for r in mined if truth[r.line_id] == t} for t in set(truth)}
    assert all(len(v) == 1 for v in by_truth.values()) and by_truth["service started"] == {"service started"}
    assert by_truth["disk {} is full now"] == {"disk <*> is full now"}
    first = min(mined, key=lambda r: r.line_id)
    assert first.event_id == "E1"


def test_mining_of_many_templates(spark):
    """Many templates in few buckets, merges, wildcards, rare and odd lines: every line's group is known by construction."""
    rng = random.Random(6)
    words = [a + b + c for a in ("ab", "cor", "del", "fin") for b in ("en", "il", "or", "us") for c in ("ta", "min", "gor", "sal", "vex")]
    shapes = [" ".join([verb, "{}", *rng.sample(words, 3), "{}", "at", rng.choice(words)]) for verb in words[:60]] + ["start " + w for w in words[:3]]
    truth, texts = [], []
    for k in range(4000):
        t = rng.choice(shapes[:20]) if k % 2 else rng.choice(shapes)
        truth.append(t)
        texts.append(t.format(*[f"{rng.choice('xyz')}{rng.randint(100, 999999)}" for _ in range(t.count("{}"))]))
    odd = ["", "   ", "<*> " * 51 + "end", "lonely line of its own 17"]
    labelled, trace = mine.mine_with_trace(lines_of(spark, texts + odd), min_size=20)
    mined = {r.line_id: r.template for r in labelled.collect()}
    assert len(mined) == len(texts) + len(odd)
    groups = {}
    for k, t in enumerate(truth):
        groups.setdefault(t, set()).add(mined[k])
    assert sum(len(g) == 1 for g in groups.values()) >= 0.95 * len(groups) and len(set().union(*groups.values())) <= 1.05 * len(groups)
    right = sum(mined[k] == t.replace("{}", "<*>") for k, t in enumerate(truth))
    assert right >= 0.95 * len(truth)
    assert trace.agg({"iter": "max"}).first()[0] < 12  # rounds, of 63 templates in two buckets


def test_mining_trace_and_masked_queries(spark):
    lines = lines_of(spark, [f"node n{k} up" for k in range(30)] + ["static text here"] * 3)
    labelled, trace = mine.mine_with_trace(lines, min_size=5, query_patterns=(r"n\d+",))
    assert {r.template for r in labelled.collect()} == {"node <*> up", "static text here"}
    steps = trace.orderBy("iter").collect()
    assert steps[0].sample[0] == "node n10 up" and steps[0].template == "node <*> up" and [r.iter for r in steps] == sorted(r.iter for r in steps)


def test_sampling(spark):
    texts = [f"job {k} of queue {k % 7} done by host{k}" for k in range(60)]
    clustered = cluster.cluster_lines(lines_of(spark, texts), 3, 5)
    pool = sampling.candidate_pool(sampling.similarities(clustered, sampling.anchors(clustered)), 0.3, 2)
    counts = pool.groupBy("cid2", "sim").count().collect()
    assert counts and all(r["count"] <= 2 and 0 < r.sim < 1 for r in counts)
    samples = sampling.contrast_samples(clustered, 0.3).collect()
    assert all(s.sample[0] == s.anchor and len(s.sample) <= 3 for s in samples)
    assert sampling.contrast_samples(clustered, 0.3, seed=1).count() == len(samples)
    assert all(len(r.sample) == 4 for r in sampling.first_samples(clustered.limit(2), 4, True).collect())


def test_evaluation_against_sets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ABCD"), rng.choice("ABCE")) for i in range(40)] + [(50 + i, "Z", "Z") for i in range(5)] + [(90, None, "A")]
    got = evaluate.metrics(evaluate.contingency(spark.createDataFrame(rows, "line_id long, gt string, parsed string"))).first()
    pairs = [r[1:] for r in rows if r[1] is not None]
    groups = {g: {i for i, p in enumerate(pairs) if p[0] == g} for g in {p[0] for p in pairs}}
    parsed = {q: {i for i, p in enumerate(pairs) if p[1] == q} for q in {p[1] for p in pairs}}
    same = [g for g in groups.values() if g in parsed.values()]
    exact = [q for q, ids in parsed.items() if {pairs[i][0] for i in ids} == {q}]
    assert got.GA == pytest.approx(sum(map(len, same)) / len(pairs)) and got.PGA == pytest.approx(len(same) / len(parsed)) and got.RGA == pytest.approx(len(same) / len(groups))
    assert got.PA == pytest.approx(sum(a == b for a, b in pairs) / len(pairs)) and got.PTA == pytest.approx(len(exact) / len(parsed))
    perfect = evaluate.metrics(evaluate.contingency(spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], "line_id long, gt string, parsed string"))).first()
    assert perfect.GA == perfect.PA == perfect.FTA == perfect.FGA == 1.0
    nothing = evaluate.metrics(evaluate.contingency(spark.createDataFrame([], "line_id long, gt string, parsed string"))).first()
    assert nothing.GA == nothing.PA == nothing.FTA == 0.0


def test_slices_and_summary(spark):
    table = evaluate.contingency(spark.createDataFrame([(i, "a <*>", "a <*>") for i in range(6)] + [(9, "b", "c")], "line_id long, gt string, parsed string"))
    assert [r.gt for r in evaluate.of_complexity(table, 2).collect()] == ["a <*>"]
    assert [r.gt for r in evaluate.of_frequency(table, 50).collect()] == ["b"] and [r.gt for r in evaluate.of_frequency(table, -50).collect()] == ["a <*>"]
    rows = evaluate.metrics(table).withColumn("dataset", F.lit("x"))
    found = {(r.measure, r.dataset): r.value for r in evaluate.summary(rows.unionByName(rows)).collect()}
    assert found["PA", "Average"] == found["PA", "x"] == 0.857
    kinds = {r.parsed: r.kind for r in evaluate.group_errors(table).collect()}
    assert kinds == {"a <*>": "accurate", "c": "accurate"}


def test_formats(spark):
    pattern, groups = logs.compile_format(r"<Date> <Component>(\[<PID>\])?: <Content>")
    assert groups == {"Date": 1, "Component": 2, "PID": 4, "Content": 5} and pattern.startswith("^")
    for p in presets.PRESETS.values():
        logs.compile_format(p.format)
    rows = spark.createDataFrame([(1, " Jan  sshd[7]: up é "), (2, "Jan cron: x"), (3, "bad"), (4, ""), (5, None)], "line_id long, line string")
    got = {r.line_id: r for r in logs.parse_lines(rows, r"<Date> <Component>(\[<PID>\])?: <Content>").collect()}
    assert set(got) == {1, 2} and got[1].pid == "7" and got[1].content == "up <N/ASCII>" and got[2].pid == ""


def test_readers_and_writers(spark, tmp_path):
    raw = tmp_path / "raw.log"
    raw.write_text("[t1] [info] a b\n\n[t2] [warn] c, \"d\"\nodd\n")
    read = logs.read_raw_log(spark, str(raw), "Apache").orderBy("line_id").collect()
    assert [(r.line_id, r.level, r.content) for r in read] == [(1, "info", "a b"), (3, "warn", 'c, "d"')]
    with pytest.raises(ValueError):
        logs.read_raw_log(spark, str(raw), "HDFS")
    labelled = spark.createDataFrame([(1, "a b", "a <*>", "E1"), (2, "NA", "NA", "E2"), (3, 'c, "d"', 'c, "d"', "E10")], "line_id long, content string, template string, event_id string")
    sinks.write_lines(labelled, str(tmp_path / "lines"))
    back = logs.read_structured_log(spark, str(tmp_path / "lines")).orderBy("line_id").collect()
    assert [(r.line_id, r.content, r.event_id, r.event_template) for r in back] == [(1, "a b", "E1", "a <*>"), (2, "NA", "E2", "NA"), (3, 'c, "d"', "E10", 'c, "d"')]
    sinks.write_templates(labelled, str(tmp_path / "templates"))
    assert [(r.event_id, r.occurrences) for r in logs.read_templates(spark, str(tmp_path / "templates")).collect()] == [("E1", 1), ("E2", 1), ("E10", 1)]
    sinks.append_metrics(spark.createDataFrame([("x", 0.12345)], "dataset string, GA double"), str(tmp_path / "metrics"))
    sinks.append_metrics(spark.createDataFrame([("y", 1.0)], "dataset string, GA double"), str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics")).count() == 2
    sinks.write_trace(spark.createDataFrame([(1, ["a"])], "iter int, lines array<string>"), str(tmp_path / "trace"))
    assert os.listdir(tmp_path / "trace")


def test_streaming_labels(spark, tmp_path):
    from tessera.streaming.lines import start_labelling

    lines_of(spark, ["user 7 in", "user 8 in", "other"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id long, content string").parquet(str(tmp_path / "in"))
    query = start_labelling(stream, spark.createDataFrame([("user <*> in",)], "template string"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/labelled")).count() == 2 and spark.read.parquet(str(tmp_path / "out/unmatched")).count() == 1


def test_matching_joins(spark):
    lines = lines_of(spark, ["a 1 c", "a 2 d", "b"]).withColumn("n_tokens", token_count(F.col("content")))
    known = spark.createDataFrame([("a <*> c",), ("a <*> <*>",)], "template string").withColumn("n_tokens", token_count(F.col("template")))
    assert {(r.line_id, r.template) for r in matching.match_templates(lines, known).collect()} == {(0, "a <*> c"), (0, "a <*> <*>"), (1, "a <*> <*>")}
    assert [r.line_id for r in matching.unmatched_lines(lines, known).collect()] == [2]
    best = {r.line_id: (r.template, r.params) for r in matching.best_template(lines, known).collect()}
    assert best == {0: ("a <*> c", ["1"]), 1: ("a <*> <*>", ["2 d"])}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_corrections(spark):
    found = {tuple(r.event_ids): r.template for r in matching.correct_templates(spark.createDataFrame([("E10", "user root in"), ("E2", "user admin in"), ("E1", "count 5"), ("E7", None)], "event_id string, template string")).collect()}
    assert found == {("E2", "E10"): "user <*> in", ("E1",): "count <*>", ("E7",): ""}
    corrections = matching.correct_templates(spark.createDataFrame([("E10", "user root in"), ("E2", "user admin in")], "event_id string, template string"))
    lines = spark.createDataFrame([(1, "E10", "user root in"), (2, "E5", "x"), (3, None, "y")], "line_id long, event_id string, template string")
    assert {r.line_id: (r.event_id, r.template) for r in matching.apply_corrections(lines, corrections).collect()} == {1: ("E2", "user <*> in"), 2: ("E5", "x"), 3: (None, "y")}


def test_labels_by_content_and_order(spark):
    lines = lines_of(spark, ["a", "b", "a", "c"])
    labelled = spark.createDataFrame([(0, "a", "old"), (2, "a", "new"), (1, "b", "b")], "line_id long, content string, template string")
    assert {r.line_id: r.template for r in matching.label_by_content(lines, labelled).collect()} == {0: "new", 1: "b", 2: "new", 3: None}
    assert [r.template for r in matching.sort_templates(spark.createDataFrame([("ab",), ("abc",), ("aa",)], "template string")).collect()] == ["abc", "aa", "ab"]


def test_similarity_matrix_against_sets(spark):
    texts = ["a b c", "b c d", "x", "a a", "x", ""]
    got = {(r.a, r.b): r.sim for r in matching.similarity_matrix(lines_of(spark, texts)).collect()}
    sets = {texts.index(t): set(t.split()) for t in texts}
    assert got == {(i, j): pytest.approx(len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in sets for j in sets if i < j and sets[i] & sets[j]}


def test_similarity_accuracy(spark):
    table = evaluate.contingency(spark.createDataFrame([(1, "a <*>", "a <*>"), (2, "a b", "c d"), (3, "a b", "a d")], "line_id long, gt string, parsed string"))
    assert evaluate.similarity_accuracy(table).first().SA == pytest.approx((1 + 0 + 1 / 3) / 3)


def test_majority_counts_every_answer(spark):
    def votes(gt, *answers):
        return [(gt, a) for a, n in answers for _ in range(n)]

    rows = votes("hundreds", ("a <*>", 101), ("b <*>", 199)) + votes("tens", ("a <*>", 93), ("b <*>", 95)) + votes("tie", ("b", 2), ("a", 2)) + votes("all", ("a", 1), ("b", 1)) + votes("one", ("a", 1)) + votes("invalid", ("<*> " * 51, 3), ("a", 1)) + votes("none", ("<*> " * 51, 2))
    df = spark.createDataFrame([(k, g, a) for k, (g, a) in enumerate(rows)], "line_id long, gt string, parsed string")
    got = {r.gt: (r.majority, r.first, r.diverse) for r in matching.majority_templates(df).collect()}
    assert got == {"hundreds": ("b <*>", "a <*>", False), "tens": ("b <*>", "a <*>", False), "tie": ("b", "b", False), "all": ("a", "a", True), "one": ("a", "a", False), "invalid": ("a", "<*> " * 51, False), "none": ("", "<*> " * 51, False)}


def test_remote_inducer_asks_again(spark, tmp_path):
    """A client that fails at first, gives nonsense for one sample at temperature 0 and a template when it is asked again."""
    log = str(tmp_path / "asked")

    def connect():
        failed = []

        def client(messages, temperature):
            asked = messages[-1]["content"]
            with open(log, "a") as f:
                f.write(f"{temperature} {asked[:20]}\n")
            if not failed:
                failed.append(1)
                raise ConnectionError("busy")
            if "disk" in asked and temperature == 0.0:
                return "LogTemplate[1]: `something else`"
            return "LogTemplate[1]: `disk {d} full on host {h} again now`" if "disk" in asked else "LogTemplate[1]: `user {u} logged in`"

        return client

    lines = lines_of(spark, [f"disk d{k} full on host h{k} again now" for k in range(9)] + [f"user u{k} logged in" for k in range(9)])
    mined = mine.mine_templates(lines, min_size=2, inducer=mine.RemoteInducer(connect, wait=0.0)).collect()
    assert {r.template for r in mined} == {"disk <*> full on host <*> again now", "user <*> logged in"}
    asked = open(log).read().splitlines()
    assert any(x.startswith("0.7") for x in asked) and all("Log[1]" in x for x in asked)


def test_settings():
    sampling = {"size": 3, "min_similarity": 0.5, "weight": 0.6, "per_level": 3}
    assert mine.Settings.of("Apache", seed=3).options() == {"sampling": sampling, "patterns": (r"HTTP/\d\.\d",), "query_patterns": (), "k": 3, "min_size": 100, "seed": 3}
    assert mine.Settings(("x",), "query").options()["query_patterns"] == ("x",) and mine.Settings(("x",), "none").options()["patterns"] == ()
    with pytest.raises(ValueError):
        mine.Settings(masks="after").options()


def test_loading_is_counted(spark, tmp_path):
    from pyspark.sql import Observation

    raw = tmp_path / "app.log"
    raw.write_text("[t1] [info] one two\n\nnot of the format\n[t2] [warn] thr\u00e9e\n")
    counts = Observation("loading")
    rows = sorted(logs.read_raw_log(spark, str(raw), "Apache", counts).collect())  # in order here: a sort in Spark reads twice
    assert [(r.line_id, r.time, r.level, r.content) for r in rows] == [(1, "t1", "info", "one two"), (4, "t2", "warn", "thr<N/ASCII>e")]
    assert counts.get == {"lines": 4, "loaded": 2}


def test_missing_results_are_nulls(spark):
    table = evaluate.contingency(spark.createDataFrame([(1, "a", "a"), (2, "b", "a")], "line_id long, gt string, parsed string"))
    rows = evaluate.with_missing(evaluate.metrics(table).withColumn("dataset", F.lit("x")), ("x", "y"))
    got = {r.dataset: r for r in evaluate.transposed(evaluate.summary(rows)).collect()}
    assert got["y"].GA is None and got["y"].ground_templates is None and got["Average"].GA == got["x"].GA == 0.0 and got["x"].PA == 0.5
