"""Labelling of a stream of lines by a table of known templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import token_count
from ..operators.matching import match_templates


def label_stream(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """A stream of (line_id, content) joined with static templates: one row for each covering template."""
    known = templates.withColumn("n_tokens", token_count(F.col("template")))
    return match_templates(lines.withColumn("n_tokens", token_count(F.col("content"))), known)


def start_labelling(lines: DataFrame, templates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write labelled lines as Parquet, batch by batch, and lines without template beside them for mining."""
    known = templates.withColumn("n_tokens", token_count(F.col("template")))

    def batch(df: DataFrame, number: int) -> None:
        sized = df.withColumn("n_tokens", token_count(F.col("content")))
        found = match_templates(sized, known).select("line_id", "content", "template")
        found.write.mode("overwrite").parquet(f"{path}/labelled/batch={number}")
        df.join(found.select("line_id").distinct(), "line_id", "left_anti").write.mode("overwrite").parquet(f"{path}/unmatched/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
