"""Vectorised text kernels that run inside Spark tasks, and the small helpers every operator shares.

All kernels work on Arrow batches in slices of a few megabytes, so their memory does not depend on the
size of a partition; longer texts are worked on in pieces that end where a word ends. Hashes are 64-bit
polynomial prefix-sum hashes with a final mix; they are the same in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import keep as materialise  # noqa: F401: the operators' one way to write what several steps read

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE_BYTE, _BASE_WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self._base, self._inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (self._base, self._inv))
        return self


_BYTES, _WORDS = Powers(_BASE_BYTE), Powers(_BASE_WORD)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))

#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Byte values for hashing that ignore the case of A-Z.
FOLDED_VALUE = _BYTE_VALUE.copy()
FOLDED_VALUE[0x41:0x5B] = _BYTE_VALUE[0x61:0x7B]


def text_slices(texts: pa.Array, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets of the rows in these bytes) in runs of about ``limit`` bytes.

    A null text counts as empty. A text longer than the limit is a run of its own, whole.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def pieces(data: np.ndarray, table: np.ndarray, limit: int = _SLICE_BYTES, hard: bool = False) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive pieces of about ``limit`` bytes; a piece ends after a byte outside of words.

    A word of more than ``limit`` bytes is in one piece with what stands before it; with ``hard`` it is cut
    between characters.
    """
    a, n = 0, len(data)
    while n - a > limit:
        b = a + limit
        while b < n:
            found = np.flatnonzero(~table[data[b : b + limit]])
            if len(found):
                b += int(found[0]) + 1
                break
            b = min(n, b + limit)
            if hard:
                while b < n and data[b] & 0xC0 == 0x80:
                    b += 1
                break
        yield a, b
        a = b
    yield a, n


class Words:
    """Words of a run of texts: where each begins and ends, which text has which, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, values: np.ndarray = _BYTE_VALUE, hashed: bool = True):
        found = [self._piece(data, a, b, offsets, table, values, hashed) for a, b in pieces(data, table)]
        self.starts, self.ends = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        #: words of text i: from first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = np.concatenate([f[2] for f in found]) if hashed else None

    @staticmethod
    def _piece(data: np.ndarray, a: int, b: int, offsets: np.ndarray, table: np.ndarray, values: np.ndarray, hashed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        data = data[a:b]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edges = offsets[(offsets > a) & (offsets < b)] - a
        begins[edges] = inside[edges + 1]
        ends[edges - 1] = inside[edges]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not hashed:
            return starts + a, ends + a, None
        powers = _BYTES.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers.up[:n], out=sums[1:])
        return starts + a, ends + a, mix((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))


class Runs:
    """Hashes of runs of consecutive words in constant time each."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self._powers = _WORDS.grow(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self._powers.up[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._powers.down[start] + (end - start).astype(np.uint64))


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of k words that lie in one text, and how many each text has."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return base + np.arange(total), counts


def long_array(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed longs, Spark's type."""
    return np.ascontiguousarray(values).view(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def arrow_batches(spark: SparkSession) -> None:
    """Keep batches to Python small: texts can be long, and a batch is counted in rows by default.

    The settings are read when a plan runs, which is after an operator returns, so they stay on the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
