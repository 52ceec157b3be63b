"""Common subsequences, common runs and edit distances of token arrays, as Arrow-batched functions.

Rows of the dynamic programs are bits of Python's integers, so a pair of n and m tokens costs n operations on m
bits. The longest common run is found by halving: runs of a length are compared by hashes, the one that is found
token by token. Nulls count as empty arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType


def _places(b: Sequence[str]) -> dict[str, int]:
    """For each token the bits of its places."""
    places: dict[str, int] = {}
    for j, token in enumerate(b):
        places[token] = places.get(token, 0) | 1 << j
    return places


def _rows(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """For each beginning of ``a`` the places of ``b`` at which its longest common subsequence does not grow, as bits."""
    places, mask = _places(b), (1 << len(b)) - 1
    rows = [mask]
    for token in a:
        row = rows[-1]
        same = row & places.get(token, 0)
        rows.append(((row + same) | (row - same)) & mask)
    return rows


def subsequence_length(a: Sequence[str], b: Sequence[str]) -> int:
    places, mask = _places(b), (1 << len(b)) - 1
    row = mask
    for token in a:
        same = row & places.get(token, 0)
        row = ((row + same) | (row - same)) & mask
    return len(b) - row.bit_count()


def subsequence(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """The longest common subsequence itself; on ties the one of fewer tokens of ``b``."""
    rows, i, j, out = _rows(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def edits(a: Sequence[str], b: Sequence[str]) -> int:
    """Insertions, deletions and substitutions of whole tokens: a column's steps up and down as bits of two numbers."""
    if not len(b):
        return len(a)
    places, mask, last = _places(b), (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, distance = mask, 0, len(b)
    for token in a:
        same = places.get(token, 0)
        across = ((((same & up) + up) ^ up) | same) & mask
        stays = (same | down) & mask
        more, less = (down | ~(across | up)) & mask, up & across
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & mask, less << 1 & mask
        up, down = (less | ~(stays | more)) & mask, more & stays
    return distance


def common_run(a: Sequence[str], b: Sequence[str]) -> tuple[int, int]:
    """(begin in ``a``, length) of the longest run of tokens in both, the first of ``a`` on ties."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in (a, b))
    rng = np.random.default_rng(7)
    of_token, base = rng.integers(1, 1 << 63, len(number) + 1, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(x), len(y)), base)]), dtype=np.uint64)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(of_token[s] * powers[: len(s)], dtype=np.uint64)]) for s in (x, y)]

    def hashes(k: int, n: int) -> np.ndarray:
        """Of all runs of n tokens, brought to one power."""
        begin = np.arange(len(sums[k]) - n)
        return (sums[k][n:] - sums[k][: len(begin)]) * powers[len(powers) - 1 - begin]

    def first(n: int) -> int:
        """The first run of n tokens of ``a`` that is one of ``b``; -1 without one."""
        own, others = hashes(0, n), hashes(1, n)
        order = np.argsort(others, kind="stable")
        at = np.searchsorted(others[order], own)
        for i in np.flatnonzero((at < len(order)) & (others[order[np.minimum(at, len(order) - 1)]] == own)):
            k = at[i]
            while k < len(order) and others[order[k]] == own[i]:
                if (y[order[k] : order[k] + n] == x[i : i + n]).all():
                    return int(i)
                k += 1
        return -1

    best, low, high = (0, 0), 0, min(len(x), len(y))
    while low < high:  # a run of n tokens holds one of n - 1
        n = (low + high + 1) // 2
        if (i := first(n)) >= 0:
            best, low = (i, n), n
        else:
            high = n - 1
    return best


def _each(f, a: pd.Series, b: pd.Series) -> list:
    return [f(() if x is None else x, () if y is None else y) for x, y in zip(a, b, strict=True)]


@pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insertions, deletions and substitutions of whole tokens."""
    return pd.Series(_each(edits, a, b))


@pandas_udf(IntegerType())
def common_subsequence_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of tokens."""
    return pd.Series(_each(subsequence_length, a, b))


@pandas_udf(ArrayType(StringType()))
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest common subsequence itself; on ties the one of fewer tokens of ``b``."""
    return pd.Series(_each(subsequence, a, b))


@pandas_udf(ArrayType(StringType()))
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest run of tokens in both, the first of ``a`` on ties."""

    def run(x: Sequence[str], y: Sequence[str]) -> list[str]:
        i, n = common_run(x, y)
        return list(x[i : i + n])

    return pd.Series(_each(run, a, b))
