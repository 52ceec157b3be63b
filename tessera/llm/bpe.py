"""Operator 3: byte-level BPE encoding and decoding through a serialised sentencepiece model.

The rank file of a byte-level vocabulary becomes a sentencepiece BPE model without any training: every
token is mapped byte by byte to one printable character each, its score is its negative rank, and the
normaliser is the identity. Sentencepiece then merges the best-scored neighbours first, leftmost on
ties, which is the merge order of the ranks.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import arrow_batches, table

#: Pre-tokens remembered by a Python worker, and their bytes; then it starts anew, so its memory is bounded. Longer
#: pre-tokens are not remembered.
CACHE_ENTRIES, CACHE_BYTES, CACHE_LONGEST = 400_000, 16 << 20, 256


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protocol-buffer field: a length-delimited one for bytes, a varint for an int."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto in which the piece of rank r has id r; the unknown piece comes last."""
    chars, by_rank = byte_characters(), sorted(ranks, key=ranks.get)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n - 1")
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_varint(k << 3) + _varint((1 << 64) - 1) for k in (41, 42, 43)))  # BPE; no begin, end and padding
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes pre-tokens with a serialised model and decodes ids by the inverse of the byte mapping."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self._split = regex.compile(pattern).findall
        self._table = {b: c for b, c in enumerate(byte_characters())}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self._whole = {k: v for k, v in ranks.items() if len(k) > 1}
        back = {c: bytes([b]) for b, c in self._table.items()}
        self._bytes = [b"".join(back[c] for c in self._model.id_to_piece(i)) for i in range(len(ranks))]
        self._known: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return self._split(text)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """A pre-token that is a token of its own is that token, however the merges would go."""
        raw = [x.encode() for x in pieces]
        ids = self._model.encode([x.decode("latin-1").translate(self._table) for x in raw], num_threads=1)
        return [[self._whole[b]] if b in self._whole else i for b, i in zip(raw, ids, strict=True)]

    def encode(self, text: str) -> list[int]:
        return [i for x in self.encode_pieces(self.split(text)) for i in x]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the ids again: (id, ids as an array, decoded as binary).

    A null text counts as empty and has no ids. Other columns are ignored; repeated rows give repeated
    results. No shuffle: each batch is encoded where it was read.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [c.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.binary())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, but with the number of ids and the digests of ids and decoded bytes only.

    Pre-tokens recur, so each worker remembers for each one its ids in decimal and their decoded bytes.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known, held = codec(path, pattern), {}, 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column(1).to_pylist():
                pieces = c.split(text or "")
                if new := [x for x in set(pieces) if x not in known]:
                    held += sum(map(len, new))
                    if len(known) + len(new) > CACHE_ENTRIES or held > CACHE_BYTES:
                        known, new = {}, list(set(pieces))
                        held = sum(map(len, new))
                    for x, ids in zip(new, c.encode_pieces(new), strict=True):
                        known[x] = (len(ids), ",".join(map(str, ids)), c.decode(ids))
                got = [known[x] for x in pieces]
                out[0].append(sum([x[0] for x in got]))
                out[1].append(hashlib.sha256(",".join([x[1] for x in got]).encode()).hexdigest())
                out[2].append(hashlib.sha256(b"".join([x[2] for x in got])).hexdigest())
                for x in [x for x in new if len(x) > CACHE_LONGEST]:
                    del known[x]
                    held -= len(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
