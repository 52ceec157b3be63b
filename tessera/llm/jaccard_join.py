"""Operator 9: n-gram Jaccard join with Bayesian candidate pruning.

1. Documents with the same set of shingles form a class; only its smallest id goes on.
2. Bands of MinHash values give candidates: two classes with a band in common. The members of a band's bucket
   are tied to the bucket's smallest one, which is linear in the bucket. Ties' components of at most
   ``BLOCK`` members are packed together and compared as a whole; members of larger ones are compared bucket
   by bucket, in blocks of pairs of chunks where a bucket is large, and a pair only in the first bucket that
   it has in common. So work follows the collisions, not the squares of components.
3. Signatures are compared a few values at a time. A pair is dropped as soon as the posterior probability that
   its similarity reaches the threshold falls below the tolerance; the rest are verified on their whole sets
   of shingles.
4. Blocks return links counted per document and a spanning forest, never the pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import arrow_batches, list_array, long_array, materialise, table
from .minhash import MinHash, bands, set_keys, shingle_runs

BANDS, ROWS = 32, 5
#: MinHash values compared before the next decision.
STEP = 20
#: Members of a component, or of a chunk of a bucket, that are compared in one block.
BLOCK = 512
#: Rows that a group of small components has on average.
PACK = 512


@functools.lru_cache(maxsize=16)
def least_matches(size: int, step: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """For step, 2 step, ... compared values: the fewest matches that keep a pair.

    With a uniform prior, m matches of n leave the similarity Beta(m + 1, n - m + 1) distributed; a pair
    goes if the part of it at and above the threshold is less than the tolerance.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= threshold
    out = []
    for n in range(step, size + 1, step):
        for m in range(n + 1):
            density = np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid))
            if density[above].mean() * above.mean() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def survivors(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left[k], right[k]) that incremental comparison does not drop."""
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(signatures.shape[1], step, threshold, tolerance)):
        part = signatures[:, k * step : (k + 1) * step]
        matches = matches + (part[left] == part[right]).sum(1, dtype=np.int32)
        keep = matches >= least
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    if len(left) <= 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    used, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    sizes = [len(sets[i]) for i in used]
    values, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(used)), sizes), times > 1
    number = np.cumsum(shared) - 1  # shingles of one document only can't be in an intersection
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(column, (at, at + 2048))
        part = np.zeros((len(used), 2048), np.float32)
        part[row[i:j], column[i:j] - at] = 1
        both += part @ part.T
    n = len(left)
    return both[where[:n], where[n:]].astype(np.int64)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest number in the component of each of n nodes."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def linked(ids: np.ndarray, weights: np.ndarray, chunks: np.ndarray | None, signatures: np.ndarray, sets: list[np.ndarray], threshold: float, tolerance: float, n_bands: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of a block, counted with the copies, and the smallest id tied to it here.

    Only pairs that share one of ``n_bands`` bands count, however large the component or the block. With ``chunks``,
    only pairs of members of two different chunks are compared; with ``before``, the bands before the block's
    own, only pairs that have none of these in common.
    """
    if chunks is None:
        left, right = np.triu_indices(len(ids), 1)
    else:
        a, b = np.flatnonzero(chunks == chunks.min()), np.flatnonzero(chunks != chunks.min())
        left, right = np.repeat(a, len(b)), np.tile(b, len(a))
    for band in () if before is None else before.T:
        mine = band[left] != band[right]
        left, right = left[mine], right[mine]
    sizes = np.array([len(s) for s in sets], np.int64)
    fits = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right]) - 1e-9
    left, right = survivors(signatures, left[fits], right[fits], threshold, tolerance)
    own = bands(signatures, n_bands)
    meet = (own[left] == own[right]).any(1)
    left, right = left[meet], right[meet]
    common = overlaps(sets, left, right)
    similar = common / np.maximum(1, sizes[left] + sizes[right] - common) >= threshold
    left, right = left[similar], right[similar]
    links = np.bincount(left, weights[right], len(ids)) + np.bincount(right, weights[left], len(ids))
    return links.astype(np.int64), ids[roots(len(ids), left, right)]


def sketches(docs: DataFrame, n: int, n_bands: int, rows: int, seed: int) -> DataFrame:
    """(id, k1, k2, bands): keys of each document's set of shingles, and its bands, null if it has none."""
    hashes = MinHash(n_bands * rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, shingles, counts in shingle_runs(batch.column(1), n):
                k1, k2, _ = set_keys(shingles, counts)
                own = bands(hashes.signatures(shingles, counts), n_bands)
                lists = list_array(pa.array(long_array(own.ravel())), np.full(j - i, n_bands))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n_bands * (j - i) + 1, n_bands, dtype=np.int32)), lists.values, mask=pa.array(counts == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(long_array(k1)), pa.array(long_array(k2)), lists], ["id", "k1", "k2", "bands"])

    return docs.mapInArrow(run, "id long, k1 long, k2 long, bands array<long>")


def with_sets(members: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """Replace the texts of (id, text, ...) by signatures and sorted sets of shingles, as binaries."""
    hashes = MinHash(size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for i, j, shingles, counts in shingle_runs(batch.column("text"), n):
                own = rest.slice(i, j - i)
                signatures = [x.tobytes() for x in hashes.signatures(shingles, counts)]
                sets = [x.tobytes() for x in set_keys(shingles, counts)[2]]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(signatures, pa.binary()), pa.array(sets, pa.binary())], [*own.schema.names, "signature", "shingles"])

    kinds = ", ".join(f"{c} {t}" for c, t in members.dtypes if c != "text")
    return members.mapInArrow(run, f"{kinds}, signature binary, shingles binary")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7, id_col: str = "doc_id", text_col: str = "text", n_bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """Link documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``.

    Returns for each row of ``docs``: the id, class_id (the smallest id with the same set of n-grams),
    n_links long (other documents linked directly, copies included), component_id (the smallest id
    reachable by links) and kept (id = component_id). A null or empty text, and a row without id, links
    with nothing; rows that repeat an id count as copies of each other; an empty table gives an empty
    result; other columns are ignored. With ``n_bands`` bands of ``rows`` values, a pair at 0.8 becomes a
    candidate with probability 1 - (1 - 0.8 ** rows) ** n_bands, all but 3 in a million at the defaults.
    With a tolerance of 0 no candidate is pruned. ``seed`` chooses the permutations.
    """
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = materialise(sketches(texts, n, n_bands, rows, seed))
    classes = materialise(own.where("id is not null and bands is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands")))

    banded = classes.select("rep", F.posexplode("bands").alias("at", "band"))
    shared = materialise(banded.groupBy("band").agg(F.min("at").alias("at"), F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("lead < last"))  # by itself, so that a hot band's rows can be split
    ties = banded.join(shared.select("band", "lead"), "band").where("rep != lead").select("rep", "lead").distinct()
    tied = materialise(connected_components(ties, "rep", "lead"))

    sized = tied.join(materialise(tied.groupBy("root").agg(F.count(F.lit(1)).alias("n"))), "root")
    packs = max(1, tied.count() // PACK)
    spot = "array(struct({} as pack, cast({} as int) as at, cast({} as int) as chunks)) as spots"
    small = sized.where(F.col("n") <= block).select(F.col("node").alias("rep"), F.expr(spot.format(f"pmod(xxhash64(root), {packs}L)", -1, 1)))
    first = shared.groupBy("size", "members", "lead", "last").agg(F.min(F.struct("at", "band")).alias("b"))  # of buckets with the same members all pairs meet in the first
    buckets = banded.drop("at").join(first.select("b.band", "b.at", "size"), "band").join(sized.where(F.col("n") > block).select(F.col("node").alias("rep")), "rep")
    large = buckets.groupBy("rep").agg(F.collect_list(F.struct(F.col("band").alias("pack"), "at", F.ceil(F.col("size") / block).cast("int").alias("chunks"))).alias("spots"))  # as many as there are bands
    members = small.unionByName(large).join(classes.select("rep", "weight"), "rep").join(tied.select(F.col("node").alias("rep"), "root"), "rep").withColumnRenamed("rep", "id")
    sets = with_sets(texts.join(members, "id").select("id", "text", "root", "weight", "spots"), n, n_bands * rows, seed)
    spread = sets.withColumn("spot", F.explode("spots")).select("id", "root", "weight", "signature", "shingles", "spot.*").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    placed = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("chunks", "other")

    def compare(group: pa.Table) -> pa.Table:
        ids, first = np.unique(group["id"].to_numpy(), return_index=True)
        group = group.take(first)
        root, weight, chunk = (group[c].to_numpy() for c in ("root", "weight", "chunk"))
        at, i, j = (group[c][0].as_py() for c in ("at", "i", "j"))
        signature, shingles = group["signature"].combine_chunks(), group["shingles"].combine_chunks()
        order = np.argsort(root, kind="stable")
        out: tuple[list, list] = ([], [])
        for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            links, low = np.zeros(len(part), np.int64), ids[part]
            if i == j or len(np.unique(chunk[part])) > 1:
                sig = np.array([np.frombuffer(signature[int(k)].as_buffer(), np.uint32) for k in part])
                own = [np.frombuffer(shingles[int(k)].as_buffer(), np.uint64) for k in part]
                links, low = linked(ids[part], weight[part], None if i == j else chunk[part], sig, own, threshold, tolerance, n_bands, None if at < 0 else bands(sig, n_bands)[:, :at])
            out[0].append(links)
            out[1].append(low)
        back = np.argsort(order, kind="stable")
        return pa.table({"id": ids, "links": np.concatenate(out[0])[back], "low": np.concatenate(out[1])[back], "whole": np.full(len(ids), at < 0)})

    found = materialise(placed.groupBy("pack", "at", "i", "j").applyInArrow(compare, "id long, links long, low long, whole boolean").where("links > 0"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    lows = found.where("whole").select(F.col("id").alias("node"), F.col("low").alias("root")).unionByName(connected_components(found.where("not whole"), "id", "low"))
    resolved = materialise(links.join(lows.withColumnRenamed("node", "id"), "id").select(F.col("id").alias("class_id"), "links", "root"))
    named = own.join(classes.select("k1", "k2", "rep", "weight", F.lit(True).alias("real")), ["k1", "k2"], "left").select("id", F.when(F.col("id").isNotNull() & F.col("bands").isNotNull(), F.col("rep")).otherwise(F.col("id")).alias("class_id"), F.when(F.col("id").isNotNull() & F.col("bands").isNotNull(), F.col("weight")).otherwise(1).alias("weight"))
    return named.join(resolved, "class_id", "left").select(
        F.col("id").alias(id_col), "class_id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("root", "class_id"), F.lit(False)).alias("kept"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
