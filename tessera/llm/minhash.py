"""Word shingles and MinHash signatures over Arrow batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .kernels import FOLDED_VALUE, PLAIN, Runs, Words, mix, text_slices, windows


def shingle_runs(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, hashes of the rows' shingles, how many each row has).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A text of fewer than ``n`` words is
    one shingle of all of them; a text without words is one shingle of its characters; an empty or null
    text has none.
    """
    for i, j, data, offsets in text_slices(texts):
        words = Words(data, offsets, PLAIN, FOLDED_VALUE)
        runs, per = Runs(words.hash), np.diff(words.first)
        starts, counts = windows(words.first, n)
        whole = runs.of(starts, starts + n)
        short = np.flatnonzero((counts == 0) & (np.diff(offsets) > 0))
        if len(short):
            own = runs.of(words.first[short], words.first[short + 1])
            for k, row in enumerate(short):
                if not per[row]:
                    own[k] = int.from_bytes(hashlib.blake2b(data[offsets[row] : offsets[row + 1]].tobytes(), digest_size=8).digest(), "little")
            whole = np.insert(whole, np.cumsum(counts)[short], own)
            counts = counts.copy()
            counts[short] = 1
        yield i, j, whole, counts


@dataclass(frozen=True)
class MinHash:
    """``size`` universal hash permutations x -> a x + b mod 2**32 (a odd) of mixed 32-bit shingle hashes."""

    size: int
    seed: int = 1

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.random.default_rng(self.seed).integers(0, 1 << 32, (2, self.size), dtype=np.uint64).astype(np.uint32)
        return a | np.uint32(1), b

    def signatures(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row of ``size`` minima for each text; all ones for a text without shingles."""
        a, b = self.parameters()
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full((len(counts), self.size), 0xFFFFFFFF, np.uint32)
        ends = np.cumsum(counts)
        for row, (i, j) in enumerate(zip(ends - counts, ends, strict=True)):
            for k in range(i, j, 1024):
                np.minimum(out[row], (x[k : min(k + 1024, j), None] * a + b).min(0), out=out[row])
        return out


def bands(signatures: np.ndarray, n_bands: int) -> np.ndarray:
    """One 64-bit hash for each band of consecutive rows of the signatures; it also holds which band it is."""
    n, size = signatures.shape
    rows = signatures.reshape(n, n_bands, size // n_bands).astype(np.uint64)
    weights = mix(np.arange(1, size // n_bands + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((rows * weights).sum(2, dtype=np.uint64) + mix(np.arange(n_bands, dtype=np.uint64)))


def set_keys(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Two 64-bit keys of each text's set of shingles, and the sets, sorted."""
    ends, k1, k2, sets = np.cumsum(counts), np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64), []
    for row, (i, j) in enumerate(zip(ends - counts, ends, strict=True)):
        own = np.unique(shingles[i:j])
        sets.append(own)
        k1[row] = mix(own).sum(dtype=np.uint64) + np.uint64(len(own))
        k2[row] = mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return k1, k2, sets
