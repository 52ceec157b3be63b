"""Remote inducers: questions at once, equal ones once, and answers that outlive a task."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import mine


def some_lines(spark):
    texts = [f"{kind} d{k} is on h{k} as of it" for kind in ("disk", "tape", "card", "drum") for k in range(9)]
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, content string")


def logging_client(log, pause=0.0, fail_after=None):
    def connect():
        open_now, lock, calls = [0, 0], threading.Lock(), [0]

        def client(messages, temperature):
            with lock:
                calls[0] += 1
                open_now[0] += 1
                open_now[1] = max(open_now)
                number = calls[0]
            time.sleep(pause)
            asked = messages[-1]["content"]
            with lock, open(log, "a") as f:
                f.write(f"{open_now[1]} {asked.split('`')[1].split()[0]}\n")
            with lock:
                open_now[0] -= 1
            if fail_after and number > fail_after and not os.path.exists(f"{log}.died"):
                open(f"{log}.died", "w").close()
                os._exit(1)  # as a lost executor
            return f"LogTemplate[1]: `{asked.split('`')[1].split()[0]} {{d}} is on {{h}} as of it`"

        return client

    return connect


EXPECTED = {f"{k} <*> is on <*> as of it" for k in ("disk", "tape", "card", "drum")}


def test_questions_run_at_once(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        log = str(tmp_path / "log")
        labelled, trace = mine.mine_with_trace(some_lines(spark), min_size=2, inducer=mine.RemoteInducer(logging_client(log, 0.3)))
        assert {r.template for r in labelled.collect()} == EXPECTED
        rows = open(log).read().splitlines()
        assert len(rows) == 4 and max(int(r.split()[0]) for r in rows) == 4
        used = mine.usage(trace).first()
        assert used.queries == used.inductions == 4 and used.seconds >= 1.2 and used.mean_seconds == pytest.approx(used.seconds / 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_questions_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")
    samples = spark.createDataFrame([(k, ["disk d1 is on h1 as of it"], 0, 0.0) for k in range(50)], "cid2 int, asked array<string>, queries int, seconds double")
    found = mine.RemoteInducer(logging_client(log)).ask(samples, 0.0).collect()
    assert len(found) == 50 and {r.answer for r in found} == {"disk <*> is on <*> as of it"} and len(open(log).read().splitlines()) == 1


def test_answers_outlive_a_run(spark, tmp_path):
    """What has an answer is never asked again, neither in another round of the same run nor in another run."""
    log, folder = str(tmp_path / "log"), str(tmp_path / "answers")
    inducer = mine.RemoteInducer(logging_client(log), memory=lambda: mine.FolderMemory(folder))
    for _ in range(2):
        assert {r.template for r in mine.mine_templates(some_lines(spark), min_size=2, inducer=inducer).collect()} == EXPECTED
    assert sorted(r.split()[1] for r in open(log).read().splitlines()) == ["card", "disk", "drum", "tape"] and len(os.listdir(folder)) == 4


def test_a_failing_task_repeats_no_answered_question(tmp_path):
    """A worker that dies in the middle: its task runs again and asks only what has no answer."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
from tests.test_inducers import EXPECTED, logging_client, some_lines
from tessera.operators import mine
conf = {{"spark.sql.shuffle.partitions": "1", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.master("local[2,3]").config(map=conf).getOrCreate()
inducer = mine.RemoteInducer(logging_client("{tmp_path}/log", 0.0, 2), in_flight=1, memory=lambda: mine.FolderMemory("{tmp_path}/answers"))
assert {{r.template for r in mine.mine_templates(some_lines(spark), min_size=2, inducer=inducer).collect()}} == EXPECTED
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    asked = [r.split()[1] for r in open(tmp_path / "log").read().splitlines()]
    assert os.path.exists(tmp_path / "log.died") and len(set(asked)) == 4 and len(asked) == 5  # the one without an answer twice


def test_memory_is_whole_or_absent(tmp_path):
    memory = mine.FolderMemory(str(tmp_path / "a"))
    assert memory.get("x") is None
    memory.put("x", "été\n")
    memory.put("x", "été\n")
    assert memory.get("x") == "été\n" and os.listdir(tmp_path / "a") == ["x"]


def test_offline_asks_nothing(spark):
    _, trace = mine.mine_with_trace(some_lines(spark), min_size=2)
    assert tuple(mine.usage(trace).select("queries", "seconds", "mean_seconds").first()) == (0, 0.0, 0.0)
    assert trace.where(F.col("queries") > 0).count() == 0
