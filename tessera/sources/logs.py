"""Readers of raw and of structured logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import keep
from .presets import PRESETS


def compile_format(log_format: str) -> tuple[str, dict[str, int]]:
    """The regular expression of a format, and the group number of each field.

    Literal parts are regular expressions already; runs of spaces match any white space. Groups that the
    literal parts open are counted, so optional parts don't shift the fields.
    """
    pattern, groups, at = "", {}, 0
    for k, part in enumerate(re.split(r"<([^<>]+)>", log_format)):
        if k % 2:
            at += 1
            groups[part] = at
            pattern += "(.*?)"
        else:
            pattern += re.sub(" +", r"\\s+", part)
            at += len(re.findall(r"(?<!\\)\((?!\?)", part))
    return f"^{pattern}$", groups


#: Stands between the fields of a line that fits; these control characters in a row aren't expected in logs.
_EDGE = "\x1f\x1e\x1f"


def _split_lines(lines: DataFrame, log_format: str, line_col: str, id_col: str) -> tuple[DataFrame, dict[str, int]]:
    """(line_id, parts): the fields of each line from place 1 on, by one match of the format; one part only if it doesn't fit."""
    pattern, groups = compile_format(log_format)
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(line_col), F.lit("")), r"(?U)^\s+|\s+$", ""), r"[^\x00-\x7F]+", "<N/ASCII>")
    marked = F.regexp_replace(clean, pattern, _EDGE + _EDGE.join(f"${k}" for k in groups.values()))
    return lines.select(F.col(id_col).alias("line_id"), F.split(F.when(clean != "", marked), _EDGE).alias("parts")), groups


def parse_lines(lines: DataFrame, log_format: str, line_col: str = "line", id_col: str = "line_id", counts: Observation | None = None) -> DataFrame:
    """Columns of a format from (line_id, line): line_id and one string for each field.

    Lines are stripped; runs of other characters than ASCII become `<N/ASCII>`; blank lines and lines that
    don't fit go; an optional field that is absent is empty. ``counts`` gets the numbers of lines read and
    loaded when the result is computed.
    """
    rows, groups = _split_lines(lines, log_format, line_col, id_col)
    fits = F.size("parts") > 1
    if counts is not None:
        rows = rows.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(fits).alias("loaded"))
    return rows.where(fits).select("line_id", *[F.get("parts", k + 1).alias(name.lower()) for k, name in enumerate(groups)])


def _numbered(rows: DataFrame) -> DataFrame:
    """Add line_id to rows that are written with ``at``, their partition and place: one row for each partition meets in one task."""
    placed = rows.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("line_id", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "at")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, line): physical lines of text files, numbered from 1 in the order of files and lines.

    The files are read once, in parts of any size. What is written numbers lines within their part; parts are numbered by
    the lines before them: a table of one row for each part, whose running sum is joined.
    """
    return _numbered(keep(spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at")))).select("line_id", "line")


def read_raw_log(spark: SparkSession, path: str, log_format: str, counts: Observation | None = None) -> DataFrame:
    """A raw log as a table; ``log_format`` is a format or the name of a preset. Nothing that fits is an error.

    The files are read once and only fields are written, those of a column where they are asked for; lines that don't
    fit leave their number. ``counts``, an Observation, gets lines and loaded.
    """
    log_format = PRESETS[log_format].format if log_format in PRESETS else log_format
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))
    rows, groups = _split_lines(raw, log_format, "line", "line_id")
    fits = F.size("parts") > 1
    if counts is not None:
        rows = rows.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(fits).alias("loaded"))
    names = [name.lower() for name in groups]
    written = keep(rows.select(F.col("line_id").alias("at"), fits.alias("loaded"), *[F.get("parts", k + 1).alias(f"f{k}") for k in range(len(names))]))
    if not written.where("loaded").limit(1).count():
        raise ValueError(f"no line of {path} fits the format")
    return _numbered(written).where("loaded").select("line_id", *[F.col(f"f{k}").alias(name) for k, name in enumerate(names)])


def stream_raw_log(spark: SparkSession, path: str, log_format: str) -> DataFrame:
    """The fields of a raw log whose files arrive one after the other, as a stream; line_id is a hash of the file's name and the line.

    A stream does not know how many lines came before, so its lines have no physical numbers; equal lines of a file
    have equal ids.
    """
    log_format = PRESETS[log_format].format if log_format in PRESETS else log_format
    raw = spark.readStream.text(path).select(F.xxhash64(F.col("_metadata.file_name"), "value").alias("line_id"), F.col("value").alias("line"))
    return parse_lines(raw, log_format)


def read_structured_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, content, event_id, event_template) of a CSV or Parquet file; ids and templates may be absent.

    All columns of a CSV file are read as strings, so no content turns into a number or a null.
    """
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)
    have = {c.lower(): c for c in raw.columns}

    def column(name: str, *names: str):
        found = next((have[x] for x in names if x in have), None)
        return (F.col(f"`{found}`") if found else F.lit(None)).cast("long" if name == "line_id" else "string").alias(name)

    return raw.select(column("line_id", "lineid", "line_id"), column("content", "content"), column("event_id", "eventid", "event_id"), column("event_template", "eventtemplate", "event_template"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, template, occurrences) of a template CSV; occurrences are null where the file has none."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").csv(path)
    seen = raw["Occurrences"].cast("long") if "Occurrences" in raw.columns else F.lit(None).cast("long")
    return raw.select(F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template"), seen.alias("occurrences"))
