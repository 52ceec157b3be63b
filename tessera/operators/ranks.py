"""Places in an order of all rows, without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import keep


def ordinals(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``, the place of each row from 0 in the order of some columns, as row_number over all rows gives it.

    Rows are dealt by ranges of the order and written, so that a range stays what it is; the counts of the ranges
    say where each begins, and rows are numbered range by range. Only as many numbers as there are ranges
    meet in one task. Rows that the order doesn't tell apart get their places in any order.
    """
    part, begin = (_other(x, rows.columns) for x in ("range", "begin"))
    columns: list[Column] = [F.col(c) for c in order]
    dealt = keep(rows.repartitionByRange(*columns).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(begin))
    begins = counts.select(part, F.coalesce(F.sum(begin).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(begin))
    within = F.row_number().over(W.partitionBy(part).orderBy(*columns)) - 1
    return dealt.withColumn(name, within).join(F.broadcast(begins), part).withColumn(name, F.col(name) + F.col(begin)).select(*rows.columns, name)


def following(rows: DataFrame, group: str, order: str, value: str, names: Sequence[str]) -> DataFrame:
    """Add ``names``, the ``value`` of the next rows of the same ``group`` in an order, as lead gives it; null where there is none.

    Rows are dealt by ranges of group and order and written, so no group is gathered in one task. The first rows of each range
    are what the range before lacks; only they meet, a few for each range.
    """
    part, ahead, own, p, g = (_other(x, [*rows.columns, *names]) for x in ("range", "ahead", "own", "in_range", "of_group"))
    one, places = F.struct(F.col(value).alias("v")), range(1, len(names) + 1)
    dealt = keep(rows.repartitionByRange(group, order).withColumn(part, F.spark_partition_id()))
    within = W.partitionBy(part, group).orderBy(order)
    heads = dealt.select(part, group, order, value, F.row_number().over(within).alias(own)).where(F.col(own) <= len(names))
    on = W.partitionBy(group).orderBy(part, order)
    lasts = heads.select(F.col(part).alias(p), F.col(group).alias(g), F.filter(F.array(*[F.lead(one, k).over(on) for k in places]), lambda x: x.isNotNull()).alias(ahead), (F.lead(part).over(on) == F.col(part)).alias(own))
    lasts = keep(lasts.where(~F.coalesce(own, F.lit(False))).drop(own))
    near = dealt.withColumn(own, F.filter(F.array(*[F.lead(one, k).over(within) for k in places]), lambda x: x.isNotNull()))
    both = near.join(lasts, (F.col(part) == F.col(p)) & F.col(group).eqNullSafe(F.col(g)))
    found = both.withColumn(own, F.concat(own, ahead))
    return found.select(*rows.columns, *[F.get(own, k - 1)["v"].alias(n) for k, n in zip(places, names, strict=True)])


def _other(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
