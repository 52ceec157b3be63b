"""Two-level clustering of log lines: by number of tokens, then by frequent tokens.

Lines that are equal are handled once, with their number as weight. Ranks over all lines are taken on
tables of distinct lengths, signatures and clusters, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content, informative_tokens, token_count
from ..plans.storage import keep
from .ranks import ordinals

TOP_TOKENS, MIN_CLUSTER = 3, 100
#: Most frequent tokens of all buckets that go to all tasks; lines whose signature needs others are taken token by token.
LISTED = 1024


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(content, first_line, weight) of (line_id, content)."""
    return lines.groupBy(content(F.col("content")).alias("content")).agg(F.min("line_id").alias("first_line"), F.count(F.lit(1)).alias("weight"))


def length_buckets(lines: DataFrame) -> DataFrame:
    """Add n_tokens, where it is not there, and cid1, the rank of the number of tokens from 0."""
    sized = lines if "n_tokens" in lines.columns else lines.withColumn("n_tokens", token_count(F.col("content")))
    ranks = ordinals(sized.select("n_tokens").distinct(), ["n_tokens"], "cid1").withColumn("cid1", F.col("cid1").cast("int"))
    return sized.join(ranks, "n_tokens")


def vocabulary(bucketed: DataFrame) -> DataFrame:
    """(cid1, token, cnt): occurrences of informative tokens in each length bucket."""
    weight = F.col("weight") if "weight" in bucketed.columns else F.lit(1)
    return bucketed.select("cid1", weight.cast("long").alias("weight"), F.explode(informative_tokens(F.col("content"))).alias("token")).groupBy("cid1", "token").agg(F.sum("weight").alias("cnt"))


def _frequent(counts: DataFrame, listed: int) -> tuple[DataFrame, list[str]]:
    """Tokens of a vocabulary that occur more often than all others do, at most ``listed``, as rows (cid1, token, cnt) and by name."""
    top = counts.orderBy(F.desc("cnt"), "cid1", "token").limit(listed + 1).collect()
    kept = [r for r in top if r.cnt > top[listed].cnt] if len(top) > listed else top
    return counts.sparkSession.createDataFrame(kept, counts.schema), sorted({r.token for r in kept})


def _top(placed: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, n, sig): the number of tokens of (keys, pos, token, cnt), and the ``k`` most frequent of them."""
    ordered = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("n"), "pos", "token"))).alias("all"))  # as many as a line has tokens
    return ordered.select(*keys, F.size("all").alias("n"), F.transform(F.slice("all", 1, k), lambda t: t["token"]).alias("sig"))


def signatures(bucketed: DataFrame, k: int = TOP_TOKENS, listed: int = LISTED) -> DataFrame:
    """Add sig: each line's ``k`` most frequent distinct tokens, the first in the line on ties.

    ``bucketed`` is of distinct lines (content, first_line, weight, n_tokens, cid1). A line is first cut to those of
    its tokens that are among the ``listed`` most frequent ones, and few different lines are left; where they are ``k`` or
    the line has no others, they decide. The other lines are taken apart, and their tokens meet the whole vocabulary.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    counts = keep(vocabulary(bucketed))
    known, names = _frequent(counts, listed)
    words = bucketed.withColumn("words", F.array_distinct(informative_tokens(F.col("content"))))
    cut = keep(words.withColumn("cut", F.filter("words", lambda t: t.isin(names))).withColumn("whole", F.size("words") == F.size("cut")).drop("words"))
    cuts = keep(cut.select("cid1", "cut", "whole").distinct())
    tops = _top(cuts.select("cid1", "cut", "whole", F.posexplode("cut").alias("pos", "token")).join(F.broadcast(known), ["cid1", "token"]), k, "cid1", "cut", "whole")
    decided = (F.coalesce("n", F.lit(0)) >= k) | (F.col("whole") & (F.coalesce("n", F.lit(0)) == F.size("cut")))
    found = keep(cuts.join(tops, ["cid1", "cut", "whole"], "left").select("cid1", "cut", "whole", decided.alias("decided"), F.coalesce("sig", F.array().cast("array<string>")).alias("sig")))
    signed = cut.join(found.where("decided"), ["cid1", "cut", "whole"]).select(*bucketed.columns, "sig")
    if not found.where("not decided").limit(1).count():
        return signed
    rest = keep(cut.join(found.where("not decided").select("cid1", "cut", "whole"), ["cid1", "cut", "whole"]).select(*bucketed.columns))
    placed = rest.select("cid1", "first_line", F.posexplode(F.array_distinct(informative_tokens(F.col("content")))).alias("pos", "token"))
    return signed.unionByName(rest.join(_top(placed.join(counts, ["cid1", "token"]), k, "first_line").drop("n"), "first_line").select(*bucketed.columns, "sig"))


def prefix_clusters(signed: DataFrame, k: int = TOP_TOKENS, min_size: int = MIN_CLUSTER) -> DataFrame:
    """(cid1, sig, sig_first, level, prefix) of each signature: level is the length of the prefix that gathers ``min_size`` lines (0: none does).

    From the longest prefix down: a prefix that enough of the lines not yet gathered share is a cluster.
    """
    sigs = keep(signed.groupBy("cid1", "sig").agg(F.sum("weight").alias("lines"), F.min("first_line").alias("sig_first")))
    sums = sigs.select("cid1", F.col("sig").alias("start"), F.col("lines").alias("open_lines"))
    sigs = sigs.withColumn("level", F.when(F.col("lines") >= min_size, k).otherwise(0))
    for n in range(k - 1, 0, -1):  # what is open under a prefix is the sum of what is open under the longer ones; no group is gathered
        sums = sums.where(F.col("open_lines") < min_size).groupBy("cid1", F.slice("start", 1, n).alias("start")).agg(F.sum("open_lines").alias("open_lines"))
        enough = sums.where(F.col("open_lines") >= min_size).select("cid1", "start", F.lit(n).alias("found"))
        sigs = sigs.withColumn("start", F.slice("sig", 1, n)).join(enough, ["cid1", "start"], "left").withColumn("level", F.when(F.col("level") == 0, F.coalesce("found", F.lit(0))).otherwise(F.col("level"))).drop("start", "found")
    prefix = F.when(F.col("level") > 0, F.expr("slice(sig, 1, level)")).otherwise(F.array().cast("array<string>"))
    return sigs.select("cid1", "sig", "sig_first", "level", prefix.alias("prefix"))


def number_clusters(prefixed: DataFrame) -> DataFrame:
    """Add cid2: clusters in order of cid1, longer prefixes first, then by their first line."""
    clusters = prefixed.groupBy("cid1", "level", "prefix").agg(F.min("sig_first").alias("cluster_first"))
    ranked = ordinals(clusters.withColumn("shorter", -F.col("level")), ["cid1", "shorter", "cluster_first"], "cid2")
    return prefixed.join(ranked.select("cid1", "level", "prefix", F.col("cid2").cast("int").alias("cid2")), ["cid1", "level", "prefix"])


def cluster_lines(lines: DataFrame, k: int = TOP_TOKENS, min_size: int = MIN_CLUSTER) -> DataFrame:
    """Distinct lines with first_line, weight, n_tokens, cid1, sig, sig_first, level, prefix and cid2."""
    sized = keep(distinct_lines(lines).withColumn("n_tokens", token_count(F.col("content"))))
    signed = signatures(length_buckets(sized), k)
    return signed.join(keep(number_clusters(keep(prefix_clusters(signed, k, min_size)))), ["cid1", "sig"])


def parents(clustered: DataFrame) -> DataFrame:
    """(cid2, cid1, size): each cluster's bucket and number of lines."""
    return clustered.groupBy("cid2", "cid1").agg(F.sum("weight").alias("size"))
