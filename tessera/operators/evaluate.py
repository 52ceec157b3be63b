"""Accuracy of parsed lines against labelled ones.

All measures come from one table, the number of lines for each pair of labelled and parsed template,
whose size depends on the templates and not on the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import normalize
from ..functions.similarity import token_similarity
from ..functions.text import message_tokens
from ..plans.storage import keep
from .ranks import ordinals


def contingency(pairs: DataFrame) -> DataFrame:
    """(gt, parsed, n) of (line_id, gt, parsed); lines without label don't count, a null parse is empty."""
    return pairs.where("gt is not null").groupBy("gt", F.coalesce("parsed", F.lit("")).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


def align(labelled: DataFrame, parsed: DataFrame, normalize_labels: bool = True) -> DataFrame:
    """(line_id, gt, parsed) of two tables (line_id, template), joined on line_id."""
    gt = F.col("g.template")
    return labelled.alias("g").join(parsed.alias("p"), "line_id").select("line_id", (normalize(gt) if normalize_labels else gt).alias("gt"), F.col("p.template").alias("parsed"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _measured(cells: DataFrame, *keys: str) -> DataFrame:
    """All measures of the cells of each group of ``keys``."""
    exact = F.col("gt") == F.col("parsed")
    sums = cells.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count_distinct("gt").alias("ground_templates"), F.count_distinct("parsed").alias("identified_templates"),
        F.coalesce(F.sum(F.when(F.col("whole"), F.col("n"))), F.lit(0)).alias("ga_lines"), F.coalesce(F.sum(F.col("whole").cast("long")), F.lit(0)).alias("ga_groups"),
        F.coalesce(F.sum(F.when(exact, F.col("n"))), F.lit(0)).alias("pa_lines"), F.coalesce(F.sum((exact & F.col("alone")).cast("long")), F.lit(0)).alias("ta"),
    )
    p, g = F.col("identified_templates"), F.col("ground_templates")
    rates = sums.select(*keys, "identified_templates", "ground_templates", _ratio(F.col("ga_lines"), F.col("lines")).alias("GA"), _ratio(F.col("ga_groups"), p).alias("PGA"), _ratio(F.col("ga_groups"), g).alias("RGA"), _ratio(F.col("pa_lines"), F.col("lines")).alias("PA"), _ratio(F.col("ta"), p).alias("PTA"), _ratio(F.col("ta"), g).alias("RTA"))
    return rates.withColumn("FGA", _harmonic(F.col("PGA"), F.col("RGA"))).withColumn("FTA", _harmonic(F.col("PTA"), F.col("RTA")))


def _cells(table: DataFrame) -> DataFrame:
    """Of a contingency table, whether a cell is all of its row and column, and whether it is alone in its column."""
    gt_total, parsed_total = F.sum("n").over(W.partitionBy("gt")), F.sum("n").over(W.partitionBy("parsed"))
    return table.withColumn("whole", (F.col("n") == gt_total) & (F.col("n") == parsed_total)).withColumn("alone", F.count(F.lit(1)).over(W.partitionBy("parsed")) == 1)


def metrics(table: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row of all measures of a contingency table; ``only`` (gt) restricts them to some labelled templates.

    GA: share of lines in groups that are parsed as exactly one template with no other line. PGA, RGA, FGA:
    the same counted in templates. PA: share of lines parsed as labelled. PTA, RTA, FTA: templates parsed
    as labelled by exactly their lines. Empty denominators give 0.
    """
    cells = _cells(table)
    if only is not None:
        cells = cells.join(only.select("gt").distinct(), "gt", "left_semi")
    return _measured(cells)


def metrics_of_slices(table: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """(slice, measures): `metrics` of each slice of the labelled templates, all in one pass over the table.

    A slice is a condition on gt, occurrences (the template's lines), rarest and commonest (its place among the
    templates from either end, from 1; ties by name) and templates (how many there are), such as
    `by_complexity` and `by_frequency`. A slice without template has zeros.
    """
    counts = keep(table.groupBy("gt").agg(F.sum("n").alias("occurrences")))
    ranked = ordinals(counts.withColumn("falling", -F.col("occurrences")), ["occurrences", "gt"], "rarest")
    ranked = ordinals(ranked, ["falling", "gt"], "commonest").withColumn("rarest", F.col("rarest") + 1).withColumn("commonest", F.col("commonest") + 1)
    known = ranked.join(F.broadcast(counts.agg(F.count(F.lit(1)).alias("templates"))))  # one row
    names = [F.when(condition, F.lit(name)) for name, condition in slices.items()]
    sliced = known.select("gt", F.explode(F.array_compact(F.array(*names))).alias("slice"))
    found = _measured(_cells(table).join(sliced, "gt"), "slice")
    every = table.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in slices])).alias("slice"))
    return every.join(found, "slice", "left").na.fill(0)


def by_complexity(wanted: int) -> Column:
    """A slice: the labelled templates of one `complexity_class`."""
    return complexity_class(F.col("gt")) == wanted


def by_frequency(percent: int) -> Column:
    """A slice: the least frequent templates up to ``percent``; with a negative one the most frequent."""
    return F.col("rarest" if percent > 0 else "commonest") <= F.floor(F.col("templates") * abs(percent) / 100)


def complexity_class(template: Column) -> Column:
    """1 without value, 2 with one to four, 3 with more; values are counted by their closing `>`."""
    n = F.char_length(template) - F.char_length(F.replace(template, F.lit(">"), F.lit("")))
    return F.when(n == 0, 1).when(n < 5, 2).otherwise(3)


def of_complexity(table: DataFrame, wanted: int) -> DataFrame:
    return table.select("gt").distinct().where(complexity_class(F.col("gt")) == wanted)


def of_frequency(table: DataFrame, percent: int) -> DataFrame:
    """The least frequent labelled templates up to ``percent``; with a negative one the most frequent."""
    counts = keep(table.groupBy("gt").agg((F.sum("n") * (1 if percent > 0 else -1)).alias("order")))
    first = F.floor(F.col("all") * abs(percent) / 100)
    return ordinals(counts, ["order", "gt"], "place").join(F.broadcast(counts.agg(F.count(F.lit(1)).alias("all")))).where(F.col("place") < first).select("gt")


MEASURES = ("GA", "PA", "FGA", "PTA", "RTA", "FTA")


def summary(rows: DataFrame) -> DataFrame:
    """(measure, dataset, value): measures of data sets, the first row of each, with the row `Average`, rounded to 3."""
    columns = ["identified_templates", "ground_templates", *MEASURES]
    one = rows.groupBy("dataset").agg(*[F.first(c, ignorenulls=True).cast("double").alias(c) for c in columns])
    average = one.agg(*[F.avg(c).alias(c) for c in columns]).withColumn("dataset", F.lit("Average"))
    return one.unionByName(average).unpivot("dataset", columns, "measure", "value").select("measure", "dataset", F.round("value", 3).alias("value"))


def with_missing(rows: DataFrame, datasets: tuple[str, ...]) -> DataFrame:
    """Rows of measures by dataset, and a row of nulls for each named data set that has none."""
    named = rows.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    return rows.join(named, "dataset", "full")


def transposed(summarised: DataFrame) -> DataFrame:
    """A row for each data set of ``summary`` and a column for each measure."""
    return summarised.groupBy("dataset").pivot("measure", ["identified_templates", "ground_templates", *MEASURES]).agg(F.first("value"))


def group_errors(table: DataFrame) -> DataFrame:
    """(parsed, kind): accurate, over (part of one group), under (several whole groups) or mixed."""
    gt_total = F.sum("n").over(W.partitionBy("gt"))
    cells = table.withColumn("complete", F.col("n") == gt_total)
    kinds = cells.groupBy("parsed").agg(F.count(F.lit(1)).alias("groups"), F.bool_and("complete").alias("complete"))
    return kinds.select("parsed", F.when((F.col("groups") == 1) & F.col("complete"), "accurate").when(F.col("groups") == 1, "over").when(F.col("complete"), "under").otherwise("mixed").alias("kind"))


def similarity_accuracy(table: DataFrame) -> DataFrame:
    """(SA): mean token similarity of labelled and parsed templates, over lines."""
    sim = token_similarity(message_tokens(F.col("gt")), message_tokens(F.col("parsed")))
    return table.agg(F.coalesce(F.sum(sim * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("SA"))
