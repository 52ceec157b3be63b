"""Operator 7: MinHash fingerprints of documents, of edited documents, and joins on their bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import jaccard_join
from .kernels import arrow_batches, table
from .minhash import MinHash, shingle_runs

#: Permutations of a fingerprint, words of a shingle, and the seed of the permutations.
SIZE, WORDS, SEED = 128, 5, 7
#: Characters of consecutive documents that a task works on at a time.
RUN_CHARS = 1 << 21


def fingerprint_rows(texts: pa.Array, n: int = WORDS, size: int = SIZE) -> np.ndarray:
    """A signature for each text; all ones for an empty one."""
    hashes = MinHash(size, SEED)
    parts = [hashes.signatures(shingles, counts) for _, _, shingles, counts in shingle_runs(texts, n)]
    return np.concatenate(parts) if parts else np.zeros((0, size), np.uint32)


def as_text(signatures: np.ndarray) -> list[str]:
    """Eight hexadecimal digits for each value."""
    return [x.astype(">u4").tobytes().hex() for x in signatures]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values, an unbiased estimate of the shingle sets' Jaccard similarity."""
    return (a == b).mean(1)


def fingerprints(docs: DataFrame, n: int = WORDS, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row. Equal texts have equal fingerprints; a null text counts as empty."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_text(fingerprint_rows(batch.column(1), n, size)), pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def fingerprint_links(docs: DataFrame, n: int = WORDS, size: int = SIZE, threshold: float = 0.8, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked through their fingerprints: id, class_id, n_links, component_id and kept of every row.

    Bands of ``rows`` values of the fingerprints meet in Spark; documents with a band in common are
    candidates, and all of them are verified on their whole sets of shingles, whose Jaccard similarity must be
    at least ``threshold``. Hot bands are compared in blocks of pairs of chunks. Nulls, empty texts, repeated
    rows and empty tables are those of `jaccard_join`, which does the work, here without pruning.
    """
    return jaccard_join(docs, n, threshold, 0.0, id_col, text_col, size // rows, rows, seed=SEED)


def _ranges(keys: DataFrame, parts: int) -> np.ndarray:
    """At most ``parts - 1`` values that cut the keys into ranges of about equal size."""
    found = keys.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 100 * parts).alias("q")).first().q if parts > 1 else []
    return np.array(sorted(set(found or [])), np.int64)


class Ranges:
    """Ranges in descending order of keys: first those of ids, then those of the keys of rows without id."""

    def __init__(self, ids: np.ndarray, lone: np.ndarray):
        self.ids, self.lone = ids, lone

    def of(self, lone: np.ndarray, key: np.ndarray) -> np.ndarray:
        with_id = len(self.ids) - np.searchsorted(self.ids, key, "left")
        return np.where(lone, len(self.ids) + 1 + len(self.lone) - np.searchsorted(self.lone, key, "left"), with_id).astype(np.int32)


def _heads(keyed: DataFrame, ranges: Ranges) -> list[tuple[int, bool, int]]:
    """(range, lone, largest key) of the ranges with rows, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lone, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(lone, key)), batch.column(0), batch.column(1)], ["part", "lone", "key"])

    rows = keyed.select("lone", "key").mapInArrow(run, "part int, lone boolean, key long").groupBy("part", "lone").agg(F.max("key").alias("key")).collect()
    return sorted((r.part, r.lone, r.key) for r in rows)


def _with_copies(ranges: Ranges, heads: list[tuple[int, bool, int]]):
    """Rows (lone, key, id, text) with the number of their range; the first of each range once more, for the range before it."""
    number = np.full(len(ranges.ids) + len(ranges.lone) + 2, -1, np.int32)
    number[[p for p, _, _ in heads]] = np.arange(len(heads))
    before = {(lone, key): (k - 1) % len(heads) for k, (_, lone, key) in enumerate(heads)}  # of the first range, the last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lone, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            first = [k for k, x in enumerate(zip(lone.tolist(), key.tolist(), strict=True)) if x in before]
            row = np.concatenate([np.arange(len(key)), np.array(first, np.int64)])
            part = np.concatenate([number[ranges.of(lone, key)], [before[bool(lone[k]), int(key[k])] for k in first]]).astype(np.int32)
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(len(row)) >= len(key)), *kept.columns], ["part", "copy", "lone", "key", "id", "text"])

    return run


def edited_fingerprints(docs: DataFrame, n: int = WORDS, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of texts and of their edited texts.

    In the edited text the last floor(n_chars / 3) code points are replaced by as many first ones of the
    next document (all if it has fewer) in descending order of ids; after the last comes the first.
    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, the
    likeness of the text's fingerprint to those of the edited text and of the next document. A null text
    counts as empty; two empty texts are alike. Rows that repeat an id follow each other in the order of
    their texts; rows without id come last, in descending order of a hash of their texts; a single document is
    its own next. Other columns are ignored.

    Documents are dealt once, by ranges of ids; the first one of each range goes to the range before it as
    well, since it follows that range's last. The ranges' bounds are as many as there are partitions.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.select(F.col("id").isNull().alias("lone"), F.coalesce("id", F.xxhash64("text")).alias("key"), "id", "text")
    if rows.where("id is null").limit(1).count():
        ranges = Ranges(_ranges(keyed.where("not lone"), parts), _ranges(keyed.where("lone"), parts))
    else:  # the texts need not be read for their keys
        keyed = rows.select(F.lit(False).alias("lone"), F.col("id").alias("key"), "id", "text")
        ranges = Ranges(_ranges(keyed, parts), np.zeros(0, np.int64))
    heads = _heads(keyed, ranges)
    if not heads:
        return spark.createDataFrame([], f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    placed = keyed.mapInArrow(_with_copies(ranges, heads), "part int, copy boolean, lone boolean, key long, id long, text string")
    dealt = placed.repartitionById(len(heads), F.col("part")).sortWithinPartitions("part", "copy", F.desc("key"), "text")

    def finish(held: list[tuple], follows: str) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids, texts = [x[0] for x in held], [x[1] for x in held]
        following = [*texts[1:], follows]
        edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for x, y in zip(texts, following, strict=True)]
        own = fingerprint_rows(pa.array([*texts, follows], pa.large_string()), n, size)
        after = fingerprint_rows(pa.array(edited, pa.large_string()), n, size)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(digests), pa.array(as_text(own[:-1])), pa.array(as_text(after)), pa.array(likeness(own[:-1], after)), pa.array(likeness(own[:-1], own[1:]))],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, ended = 0, None, False
        for batch in batches:
            for p, copy, i, text in zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "id", "text")), strict=True):
                if p != part:
                    part, ended = p, False
                if ended:  # further copies, of rows that repeat an id
                    continue
                if copy or size > RUN_CHARS:  # the first copy follows the range's last
                    yield from finish(held, text or "")
                    held, size, ended = [], 0, copy
                if not copy:
                    held.append((i, text or ""))
                    size += len(text or "")

    kinds = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "copy", "id", "text").mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def document_fingerprint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that fingerprints' bands find among all documents, verified."""
    return fingerprint_links(table(spark, sf_dir, "documents"))
