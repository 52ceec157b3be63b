"""Similarities and distances of token arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import common_subsequence as common_subsequence
from .sequences import common_subsequence_length as common_subsequence_length
from .sequences import edit_distance as edit_distance
from .sequences import longest_common_run as common_run
from .text import let

SMOOTHING, LENGTH_SCALE = 1e-5, 20


def shared(a: Column, b: Column) -> Column:
    """Distinct tokens in both."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of tokens; 0 if both are empty."""
    return let(F.size(F.array_union(a, b)), lambda union: F.when(union == 0, F.lit(0.0)).otherwise(shared(a, b) / union))


def jaccard_to_many(anchor: Column, others: Column) -> Column:
    return F.transform(others, lambda x: jaccard(anchor, x))


def masked_jaccard_to_many(anchor: Column, others: Column, is_masked) -> Column:
    """Without the words that ``is_masked`` names; token arrays that lose all words are left out."""

    def bare(x: Column) -> Column:
        return F.filter(x, lambda w: ~is_masked(w))

    return let(bare(anchor), lambda own: F.transform(F.filter(F.transform(others, bare), lambda x: F.size(x) > 0), lambda x: jaccard(own, x)))


def pairwise(lines: Column) -> Column:
    """Jaccard similarities of all pairs of an array of token arrays, row by row of the upper triangle."""

    def all_pairs(lines: Column) -> Column:
        n = F.size(lines)
        return F.flatten(F.transform(lines, lambda x, i: F.transform(F.slice(lines, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: jaccard(x, y))))

    return let(lines, all_pairs)


def mean(values: Column) -> Column:
    return let(values, lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def mean_difference(values: Column) -> Column:
    """Mean absolute difference of all pairs; 0 for a single value."""

    def spread(v: Column) -> Column:
        n = F.size(v)
        differences = F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.abs(x - y))))
        return F.when(n < 2, F.lit(0.0)).otherwise(mean(differences))

    return let(values, spread)


def contrast_score(lines: Column, weight: float) -> Column:
    """Low for lines that are unlike each other in equal steps: weight x mean + (1 - weight) x spread of all pairs."""
    return let(pairwise(lines), lambda s: weight * mean(s) + (1 - weight) * mean_difference(s))


def _to_first(lines: Column) -> Column:
    """Similarities of all lines but the first to it."""
    return let(lines, lambda x: jaccard_to_many(F.get(x, 0), F.slice(x, 2, F.size(x))))


def contrast_score_anchor(lines: Column, weight: float) -> Column:
    """As ``contrast_score``, of the similarities to the first line only."""
    return let(_to_first(lines), lambda s: weight * mean(s) + (1 - weight) * mean_difference(s))


def contrast_score_mixed(lines: Column, weight: float) -> Column:
    """The mean of the similarities to the first line, the spread of those of all pairs."""
    return let(lines, lambda x: weight * mean(_to_first(x)) + (1 - weight) * mean_difference(pairwise(x)))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which arrays of equal length differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def smoothed_jaccard(a: Column, b: Column) -> Column:
    """Never 0: a little is added to both sizes."""
    return (shared(a, b) + F.lit(SMOOTHING)) / (F.size(F.array_union(a, b)) + F.lit(SMOOTHING))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Grows with the lengths of both."""
    return smoothed_jaccard(a, b) * F.pow(F.size(a) * F.size(b) / float(LENGTH_SCALE**2), F.lit(2.0))


def token_similarity(a: Column, b: Column) -> Column:
    """Distinct tokens in common over the tokens of both."""
    n = shared(a, b)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(n / (F.size(a) + F.size(b) - n))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters with which both begin."""
    n = F.least(F.char_length(a), F.char_length(b))
    return F.aggregate(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), F.lit(0), lambda done, i: F.when((done == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(done))


def common_prefix(a: Column, b: Column) -> Column:
    return F.left(a, common_prefix_length(a, b))


def common_suffix(a: Column, b: Column) -> Column:
    return F.reverse(common_prefix(F.reverse(a), F.reverse(b)))
