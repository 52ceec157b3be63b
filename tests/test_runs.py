"""Whole runs: what a folder of results holds, and what runs share."""

import pytest

from tessera.operators.mine import Settings
from tessera.plans import runs


def test_runs_write_folders_of_their_own(spark, tmp_path):
    raw, out = tmp_path / "app.log", str(tmp_path / "results")
    texts = [f"user u{k} logged in from host{k}" for k in range(6)] + ["server started"] * 3
    raw.write_text("not of the format\n" + "".join(f"[t{k}] [info] {t}\n" for k, t in enumerate(texts)))
    truth = spark.createDataFrame([(k + 2, "user <*> logged in from <*>" if k < 6 else "server started") for k in range(9)], "line_id long, event_template string")
    first = runs.mine_log(spark, str(raw), out, "Apache", truth=truth, complexities=(1, 2))
    second = runs.mine_log(spark, str(raw), out, "other", "[<Time>] [<Level>] <Content>".replace("[", r"\[").replace("]", r"\]"), Settings(min_size=1))
    assert first != second and "/Apache/" in first and "/other/" in second

    def table(name, folder=first):
        return spark.read.option("header", True).csv(f"{folder}/{name}")

    assert {(r.EventTemplate, r.Occurrences) for r in table("templates").collect()} == {("user <*> logged in from <*>", "6"), ("server started", "3")}
    assert sorted(int(r.LineId) for r in table("lines").collect()) == list(range(2, 11))
    run = spark.read.json(f"{first}/run").first()
    assert (run["dataset"], run["lines"], run["loaded"], run["queries"]) == ("Apache", 10, 9, 0)
    assert run["inductions"] >= 2 and run["read_seconds"] > 0 and run["mine_seconds"] > 0 and run["lines_per_second"] > 0
    assert {r["slice"]: (r.GA, r.PA) for r in table("metrics").collect()} == {"all": ("1.0", "1.0"), "complexity 1": ("1.0", "1.0"), "complexity 2": ("1.0", "1.0")}
    assert {r.run for r in table("metrics", out).collect()} == {first}
    assert '"min_size": 1' in spark.read.json(f"{second}/settings").first().settings
    assert spark.read.json(f"{second}/lineage").count() >= 2 and spark.read.json(f"{second}/trace").count() >= 2


def test_runs_that_cannot_start_write_nothing(spark, tmp_path):
    raw = tmp_path / "odd.log"
    raw.write_text("nothing fits\n")
    for dataset, form in (("Apache", None), ("unknown", None)):
        with pytest.raises(ValueError):
            runs.mine_log(spark, str(raw), str(tmp_path / "out"), dataset, form)
    assert not (tmp_path / "out").exists()
