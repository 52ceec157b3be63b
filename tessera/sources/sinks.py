"""Writers of parsed lines, templates, traces and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import template_table


def write_lines(labelled: DataFrame, path: str, file_format: str = "csv") -> None:
    """LineId, Content, EventId, EventTemplate in the order of lines."""
    rows = labelled.select(F.col("line_id").alias("LineId"), F.col("content").alias("Content"), F.col("event_id").alias("EventId"), F.col("template").alias("EventTemplate")).orderBy("LineId")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').format(file_format).save(path)


def write_templates(labelled: DataFrame, path: str, file_format: str = "csv") -> None:
    """EventId, EventTemplate, Occurrences in the order of ids' numbers."""
    rows = template_table(labelled).select(F.col("event_id").alias("EventId"), F.col("template").alias("EventTemplate"), F.col("occurrences").alias("Occurrences"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').format(file_format).save(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """One JSON object for each induction step."""
    trace.write.mode("overwrite").json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows of measures, rounded to 3, to a CSV table with a header in each file."""
    rounded = metrics.select(*[F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])
    rounded.write.mode("append").option("header", True).csv(path)
