"""Operator 13: a uniform shuffle into shards of exact sizes, with DataFrame functions only.

1. Rows are written once, with their place. Sources are runs of at most ``SOURCE_ROWS`` consecutive rows of a
   partition, so no source outgrows a task, whatever the input's partitions are.
2. The communication matrix (rows of a source that go to a shard) is drawn from the sources' counts alone. Each of a
   source's rows is a token that draws a shard; the tokens are counted, and the shards that have drawn too many give
   up their tokens of the smallest second numbers to those that have too few. No step tells rows apart but by
   independent numbers, and the shards' sizes are fixed, so every assignment is as likely as any other: the
   matrix has the multivariate hypergeometric law. About the square root of all rows move.
3. Every source is permuted by itself and cut at the sums of its row of the matrix.
4. The exchange: a shard's rows are permuted again, by ranks within random runs and the runs' begins.

Numbers are hashes of seed and place: a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import materialise, table

#: Rows of a source, as a power of two, and rows that one task ranks within a shard, about.
SOURCE_BITS, RUN_ROWS = 15, 50_000
#: Tokens looked at besides twice those to be given up.
SPARE = 64


def _drawn(seed: int, what: int, *of: Column) -> Column:
    """A number of 63 bits, evenly distributed and independent for each ``what``."""
    return F.xxhash64(F.lit(seed), F.lit(what), *of).bitwiseAND(F.lit((1 << 63) - 1))


def communication_matrix(sources: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """(source, shard, n): how many of the rows of (source, rows) go to each shard; pairs without rows are left out.

    Sums over shards are the sources' rows; sums over sources differ by one at most, the first shards have the
    larger ones. Sources must be distinct.
    """
    tokens = sources.select("source", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("k")).select("source", F.pmod(_drawn(seed, 1, F.col("source"), F.col("k")), F.lit(shards)).cast("int").alias("shard"), _drawn(seed, 2, F.col("source"), F.col("k")).alias("key"))
    counts = materialise(tokens.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("shard").agg(F.sum("n").alias("drawn"))
    every = F.broadcast(sources.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("all")))  # one row
    wanted = F.expr(f"`all` div {shards}") + (F.col("shard") < F.col("all") % shards).cast("long")
    sizes = sources.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(totals, "shard", "left").join(every).select("shard", F.coalesce("drawn", F.lit(0)).alias("drawn"), wanted.alias("wanted"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # over as many rows as there are shards
    over, under = F.greatest(F.col("drawn") - F.col("wanted"), F.lit(0)), F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0))
    plan = materialise(sizes.select("shard", "drawn", over.alias("over"), under.alias("under"), F.coalesce(F.sum(over).over(before), F.lit(0)).alias("over_from"), F.coalesce(F.sum(under).over(before), F.lit(0)).alias("under_from")))
    surplus = plan.where("over > 0")

    share, leaving = 2, None
    while True:  # twice the tokens wanted, nearly always enough; else more of them, at last all
        bound = F.least(F.lit(1.0), (share * F.col("over") + SPARE) / F.col("drawn"))
        near = tokens.join(F.broadcast(surplus.select("shard", "over", "over_from", (bound * float(1 << 63)).alias("bound"))), "shard").where((F.col("bound") >= float(1 << 63)) | (F.col("key") < F.col("bound")))
        rank = F.row_number().over(W.partitionBy("shard").orderBy("key", "source"))
        leaving = materialise(near.withColumn("rank", rank).where("rank <= over").select("source", "shard", (F.col("over_from") + F.col("rank") - 1).alias("at")))
        short = surplus.join(leaving.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard", "left").where("coalesce(n, 0) < over")
        if not short.limit(1).count():
            break
        share *= 8
    places = plan.where("under > 0").select(F.col("shard").alias("to"), F.explode(F.sequence("under_from", F.col("under_from") + F.col("under") - 1)).alias("at"))
    moves = leaving.join(places, "at")
    changes = counts.unionByName(moves.select("source", "shard", F.lit(-1).cast("long").alias("n"))).unionByName(moves.select("source", F.col("to").alias("shard"), F.lit(1).cast("long").alias("n")))
    return changes.groupBy("source", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def shuffled_shards(docs: DataFrame, shards: int, seed: int = 1, source_bits: int = SOURCE_BITS, run_rows: int = RUN_ROWS) -> DataFrame:
    """All columns of ``docs`` with shard (from 0) and slot (from 0, without gaps, in each shard): a uniform random order.

    Shards differ by one row at most. Each row counts by itself: rows that are equal, hold nulls or repeat an
    id go wherever they are drawn, so copies do not stay together. With fewer rows than shards the last
    shards are empty; an empty table gives an empty result. Columns may have any name but are carried
    through both exchanges: select those that are wanted.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = materialise(docs.toDF(*names).withColumn("at", F.monotonically_increasing_id())).withColumn("source", F.shiftright("at", source_bits))
    sources = materialise(rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows")))
    matrix = communication_matrix(sources, shards, seed)
    bounds = matrix.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))  # as many as there are shards
    ends = F.aggregate("cells", F.array().cast("array<struct<shard:int,end:long>>"), lambda done, c: F.concat(done, F.array(F.struct(c["shard"].alias("shard"), (F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)) + c["n"]).alias("end")))))
    local = F.row_number().over(W.partitionBy("source").orderBy(_drawn(seed, 3, F.col("at")), "at"))
    placed = rows.withColumn("rank", local).join(bounds.select("source", ends.alias("ends")), "source")
    shard = F.get(F.filter("ends", lambda e: F.col("rank") <= e["end"]), 0)["shard"]
    dealt = placed.select(*names, "at", shard.alias("shard"), _drawn(seed, 4, F.col("at")).alias("key"))

    total = sources.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    runs = max(1, total // shards // run_rows)
    dealt = dealt.withColumn("run", F.pmod("key", F.lit(runs)))
    sizes = materialise(dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")))
    begins = sizes.select("shard", "run", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))  # counts of runs only
    within = F.row_number().over(W.partitionBy("shard", "run").orderBy("key", "at")) - 1
    return dealt.withColumn("within", within).join(begins, ["shard", "run"]).select(*[F.col(x).alias(c) for x, c in zip(names, docs.columns, strict=True)], "shard", (F.col("begin") + F.col("within")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 1, files: int = 1) -> None:
    """Write each shard to a folder `shard=k` of ``files`` Parquet files, its rows in the order of their slots."""
    dealt = shuffled_shards(docs, shards, seed)
    part = F.floor(F.col("slot") * files / F.greatest(F.lit(1), F.lit(-(-docs.count() // shards))))
    dealt.withColumn("part", F.least(part, F.lit(files - 1))).repartition(shards * files, "shard", "part").sortWithinPartitions("shard", "part", "slot").drop("part").write.partitionBy("shard").parquet(path)


def op13_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shuffled_shards(rows, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
