"""Mining on a stream: batches of lines are labelled by the templates so far, and what these don't cover is mined.

The template database is a table that each batch reads as the one before has left it and writes anew, with what merges
have done: entries are added, never changed, and one that has merged says so by the entry that replaces it. Lines are
written once, with their entries; what an entry has become by merges is looked up when results are read. All that a batch
writes lies under its number and is overwritten if the batch runs again, so a failure repeats nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import mask, token_count
from ..operators.matching import match_templates
from ..operators.mine import merge_forest, mine_rounds
from ..plans.storage import keep

#: Rounds that a batch may take: entries of a later batch have higher numbers.
ROUNDS = 1 << 12
_ENTRIES = "n_tokens int, entry long, template string, round int, replaces long"
_WAITING = "line_id long, content string, n_tokens int, since int"


def _state(spark: SparkSession, path: str, name: str, number: int, schema: str) -> DataFrame:
    """What batch ``number`` has left; nothing before the first."""
    return spark.read.schema(schema).parquet(f"{path}/{name}/batch={number}") if number >= 0 else spark.createDataFrame([], schema)


def forest(entries: DataFrame) -> DataFrame:
    """(n_tokens, entry, template, round, parent, root, root_template) of all entries."""
    return merge_forest(entries.withColumnRenamed("n_tokens", "cid1")).withColumnRenamed("cid1", "n_tokens")


def mine_batch(lines: DataFrame, number: int, path: str, least: int = 1, patience: int = 10, patterns: tuple[str, ...] = (), **options) -> None:
    """Label the lines (line_id, content) of one batch by the templates of batch ``number`` - 1 and mine the rest.

    Lines without template wait until ``least`` of their number of tokens do, at most for ``patience`` batches. ``options``
    are those of `mine_rounds`; ``patterns`` mask the lines first.
    """
    spark = lines.sparkSession
    entries, waited = _state(spark, path, "entries", number - 1, _ENTRIES), _state(spark, path, "waiting", number - 1, _WAITING)
    fresh = lines.select("line_id", mask(F.col("content"), patterns).alias("content")).withColumn("n_tokens", token_count(F.col("content")).cast("int")).withColumn("since", F.lit(number))
    asked = keep(fresh.unionByName(waited))
    gone = entries.where("replaces is not null").select("n_tokens", F.col("replaces").alias("entry"))
    current = keep(entries.join(gone, ["n_tokens", "entry"], "left_anti").select("n_tokens", "entry", "template"))
    found = keep(match_templates(asked, current).groupBy("line_id", "content", "n_tokens").agg(F.min(F.struct("entry", "template")).alias("b")).select("line_id", "content", "n_tokens", "b.entry", "b.template"))
    rest = asked.join(found.select("line_id"), "line_id", "left_anti")
    due = rest.groupBy("n_tokens").agg((F.count(F.lit(1)) >= least).alias("many"), F.min("since").alias("first")).where(F.col("many") | (F.col("first") <= number - patience)).select("n_tokens")
    rest = keep(rest)
    ready = keep(rest.join(due, "n_tokens", "left_semi"))
    if ready.limit(1).count():
        labelled, _, added = mine_rounds(ready.select("line_id", "content"), earlier=current, first_round=number * ROUNDS, **options)
        found = found.unionByName(labelled.withColumn("n_tokens", token_count(F.col("content")).cast("int")).select("line_id", "content", "n_tokens", "entry", "template"))
        entries = entries.unionByName(added.select("n_tokens", "entry", "template", "round", "replaces"))
    found.write.mode("overwrite").parquet(f"{path}/labelled/batch={number}")
    entries.write.mode("overwrite").parquet(f"{path}/entries/batch={number}")
    rest.join(due, "n_tokens", "left_anti").select("line_id", "content", "n_tokens", "since").write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")


def start_mining(lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Mine a stream of (line_id, content), batch by batch; ``options`` are those of `mine_batch`. Results: `mined_lines`."""
    each: Callable[[DataFrame, int], None] = lambda df, number: mine_batch(df, number, path, **options)
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def mined_lines(spark: SparkSession, path: str, last: int) -> tuple[DataFrame, DataFrame]:
    """((line_id, content, template, entry), entries): the lines up to batch ``last`` with what their templates have become."""
    entries = forest(_state(spark, path, "entries", last, _ENTRIES))
    labelled = spark.read.parquet(*[f"{path}/labelled/batch={k}" for k in range(last + 1)])
    named = labelled.join(entries.select("n_tokens", "entry", "root", "root_template"), ["n_tokens", "entry"], "left")
    return named.select("line_id", "content", F.coalesce("root_template", "template").alias("template"), F.coalesce("root", "entry").alias("entry")), entries
