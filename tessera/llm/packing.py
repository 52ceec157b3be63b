"""Operator 2: best-fit packing planned over a histogram of lengths.

1. Every document is tokenised where it is read; only small rows (document, piece, start, length,
   checksum) go on. Documents of more than ``max_len`` tokens are cut: the remainder first, then full
   pieces.
2. The histogram of piece lengths has at most ``max_len`` rows whatever the input, so best-fit
   decreasing runs over counts on the driver: all pieces of a length that meet the same free space are
   placed at once.
3. The plan is a table of slots by length and rank. Pieces get their rank within their length from
   counts over hash buckets, so no length meets in one task, and join the plan on length and rank.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_characters
from .kernels import arrow_batches, materialise, table

#: Pieces of one length, about, that one task ranks.
BUCKET_ROWS = 100_000
#: White space of a length from which a text goes to the tokenizers library; sought where a run begins only, so in one pass.
LONG_RUN = re.compile(r"(?<!\s)\s{50000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tokens:
    """Token ids of a text as little-endian unsigned 32-bit words, as the tokenizers library gives them.

    A byte-level BPE whose merges stand in the order of their tokens' ids is the same thing as its ids taken
    as ranks, so tiktoken, which is several times as fast, encodes by the file's own vocabulary; the file's
    added tokens are special tokens to it, which are sought in the text first and have their own ids. Files
    of any other kind are left to tokenizers itself, and so are texts that hold ``LONG_RUN`` white spaces in a
    row or more: tiktoken's pattern fails on very long ones.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._model = Tokenizer.from_file(path)
        ranks, added = ranks_of(path) or (None, {})
        self._added = set(added)
        self._ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added) if ranks else None

    def __call__(self, text: str) -> bytes:
        if self._ranked and not LONG_RUN.search(text):
            return self._ranked.encode_to_numpy(text, allowed_special=self._added, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self._model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The vocabulary of a tokenizers file as ranks, and its added tokens; None if it isn't a plain byte-level BPE.

    Plain are files whose ids stand in the order of the merges and whose added tokens are taken as they are,
    wherever they stand.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    merges, added = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], spec.get("added_tokens") or []
    if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
        return None
    back, special = {c: b for b, c in enumerate(byte_characters())}, {x["content"]: x["id"] for x in added}
    return {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}, special


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def token_pieces(docs: DataFrame, path: str, max_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is one piece, the end id."""
    arrow_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % max_len or max_len, n + 1, max_len)] if n > max_len else [0, n]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(out, (doc, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def plan_slots(histogram: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, end rank, first sequence, offset).

    The piece of a length with a rank in [first, end) goes to sequence ``first sequence + rank - first``.
    Open sequences are kept as runs (first sequence, how many) by their free space. The pieces of a length
    fill the smallest free space that takes them, and new sequences when there is none; each sequence takes
    as many as it can before the next one is touched, as best fit piece by piece would.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = next((r for r in range(length, max_len + 1) if free.get(r)), max_len)
            first, many = free[room].pop() if free.get(room) else (opened, left)
            per = min(room // length, left)
            take = min(many, left // per)
            if first == opened:
                opened, many = opened + take, take
            for k in range(per):
                slots.append((length, rank + k * take, rank + (k + 1) * take, first, max_len - room + k * length))
            free[room - per * length].append((first, take))
            if take < many:
                free[room].append((first + take, many - take))
            rank, left = rank + per * take, left - per * take
    return slots


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add ``rank``, from 0 within each length, without gathering a length in one task.

    Pieces are ranked within hash buckets of a length; the buckets' counts, ``buckets`` rows for each
    length at most, give where each bucket begins.
    """
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    counts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.withColumn("begin", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("begin", F.lit(0)).alias("begin"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")) - 1
    return bucketed.withColumn("within", within).join(begins, ["length", "bucket"]).withColumn("rank", F.col("begin") + F.col("within")).drop("bucket", "begin", "within")


def best_fit_packing(docs: DataFrame, path: str, max_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``max_len`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece. A null or
    empty text is its end id alone; repeated rows are packed as often as they occur; an empty table gives
    an empty result; other columns are ignored. The plan that goes to all tasks has rows only for
    lengths and runs of equal free space: its size is bounded by ``max_len``, not by the documents.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, path, max_len, end_id, id_col, text_col))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(histogram, max_len), "length long, first_rank long, end_rank long, first_sequence long, offset long")
    placed = ranked(pieces, max(64, max(histogram.values(), default=0) // BUCKET_ROWS)).alias("p").join(F.broadcast(plan.alias("s")), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return placed.select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
