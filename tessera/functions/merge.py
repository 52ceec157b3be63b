"""Merging of two templates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .match import matches_guarded
from .normalize import from_answer
from .similarity import common_prefix_length, edit_distance, smoothed_jaccard
from .text import WILDCARD, is_valid_template, let, space_tokens, template_tokens

#: Stands for a wildcard where its characters must not count.
_MARK = "\x00"


def differing(a: Column, b: Column) -> Column:
    """Positions at which token arrays of equal length differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


def may_merge(new: Column, old: Column) -> Column:
    """Equal length; one differing token, or two if there are more than ten."""
    a, b = template_tokens(new), template_tokens(old)
    d = differing(a, b)
    return (F.size(a) == F.size(b)) & ((d <= 1) | ((d == 2) & (F.size(a) > 10)))


def may_merge_by_share(new: Column, old: Column) -> Column:
    """Equal length; less than a fifth of the tokens differ."""
    a, b = template_tokens(new), template_tokens(old)
    return (F.size(a) == F.size(b)) & (differing(a, b) / F.greatest(F.size(a), F.lit(1)) < 0.2)


def may_merge_by_distance(new: Column, old: Column) -> Column:
    """One edit, or much in common, or both long and few edits."""
    a, b = template_tokens(new), template_tokens(old)
    edits = edit_distance(a, b)
    long = (F.size(a) > 10) & (F.size(b) > 10)
    return (edits <= 1) | (smoothed_jaccard(space_tokens(new), space_tokens(old)) > 0.8) | (long & (edits / F.greatest(F.size(a), F.size(b)) <= 0.3))


def _others(token: Column) -> Column:
    """Distinct characters of a token that are no ASCII letters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(token, "[A-Za-z]", ""), ""), lambda c: c != ""))


def are_variable(x: Column, y: Column) -> Column:
    """Whether two tokens look like two values of one variable.

    Capitals only, or other characters than letters in both; but not words with a dot, an underscore or a
    colon at the end each, nor calls `f()`, nor anything with five dots.
    """
    return let(
        F.struct(*[v.alias(n) for m, t in (("x", x), ("y", y)) for n, v in ((m, F.replace(t, F.lit(WILDCARD), F.lit(_MARK))), ("d" + m, _others(F.replace(t, F.lit(WILDCARD), F.lit(_MARK)))))]),
        lambda s: _alike_values(s["x"], s["y"], s["dx"], s["dy"]),
    )


def _alike_values(x: Column, y: Column, dx: Column, dy: Column) -> Column:
    single = (F.size(dx) == 1) & (F.size(dy) == 1)

    def both(c: str) -> Column:
        return F.array_contains(dx, c) & F.array_contains(dy, c)

    names = single & (both(".") | both("_") | (both(":") & F.endswith(x, F.lit(":")) & F.endswith(y, F.lit(":"))))
    calls = (F.size(dx) == 2) & (F.size(dy) == 2) & F.endswith(x, F.lit("()")) & F.endswith(y, F.lit("()"))
    dots = F.contains(x, F.lit(".....")) | F.contains(y, F.lit("....."))
    capitals = F.rlike(x, F.lit("^[A-Z]*$")) & F.rlike(y, F.lit("^[A-Z]*$"))
    return capitals | ((F.size(dx) > 0) & (F.size(dy) > 0) & ~names & ~calls & ~dots)


def is_variable_token(t: Column) -> Column:
    """The stricter test of one token by itself."""
    t = F.replace(t, F.lit(WILDCARD), F.lit(_MARK))
    d = _others(t)
    name = (F.size(d) == 1) & (F.array_contains(d, ".") | F.array_contains(d, "_") | F.endswith(t, F.lit(":")))
    call = (F.size(d) == 2) & F.endswith(t, F.lit("()"))
    return F.rlike(t, F.lit("^[A-Z]*$")) | ((F.size(d) > 0) & ~name & ~call & ~F.contains(t, F.lit(".....")))


def are_variable_both(x: Column, y: Column) -> Column:
    return is_variable_token(x) & is_variable_token(y)


def are_variable_naive(x: Column, y: Column) -> Column:
    """Neither has letters only."""
    return (F.size(_others(x)) > 0) & (F.size(_others(y)) > 0)


def _collapsed(t: Column) -> Column:
    return F.regexp_replace(t, r"(?:<\*>)+", WILDCARD)


def merge_tokens(x: Column, y: Column) -> Column:
    """The common beginning, a wildcard and the common end; null for tokens that aren't variable."""

    def merged(head: Column) -> Column:
        tail = common_prefix_length(F.reverse(F.substr(x, head + 1)), F.reverse(F.substr(y, head + 1)))
        return _collapsed(F.concat(F.left(x, head), F.lit(WILDCARD), F.right(x, tail)))

    return F.when((x == WILDCARD) | (y == WILDCARD), WILDCARD).when(are_variable(x, y), let(common_prefix_length(x, y), merged))


def merge_tokens_by_character(x: Column, y: Column) -> Column:
    """A wildcard where the characters at a position differ, and the rest of the longer token; null as above."""
    a, b = (F.split(F.replace(t, F.lit(WILDCARD), F.lit(_MARK)), "") for t in (x, y))
    both = F.array_join(F.zip_with(a, b, lambda p, q: F.when(p.isNull(), q).when(q.isNull() | (p == q), p).otherwise(_MARK)), "")
    merged = F.replace(F.regexp_replace(both, f"{_MARK}+", _MARK), F.lit(_MARK), F.lit(WILDCARD))
    return F.when((x == WILDCARD) | (y == WILDCARD), WILDCARD).when(are_variable(x, y), merged)


def merge_lists(a: Column, b: Column) -> Column:
    """Common first and last tokens around one wildcard; null unless one has several wildcards.

    The common tokens end where either has a wildcard.
    """

    def count(t: Column) -> Column:
        return F.size(F.filter(t, lambda x: x == WILDCARD))

    def alike(p: Column, q: Column) -> Column:
        n = F.least(F.size(p), F.size(q))
        return F.aggregate(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), F.lit(0), lambda done, i: F.when((done == i - 1) & (F.get(p, i - 1) == F.get(q, i - 1)) & (F.get(p, i - 1) != WILDCARD), i).otherwise(done))

    head = alike(a, b)
    rest_a, rest_b = F.slice(a, head + 1, F.size(a)), F.slice(b, head + 1, F.size(b))
    tail = alike(F.reverse(rest_a), F.reverse(rest_b))
    merged = F.concat(F.slice(a, F.lit(1), head), F.array(F.lit(WILDCARD)), F.slice(a, F.size(a) - tail + 1, tail))
    one = F.array(F.lit(WILDCARD))
    return F.when((count(a) <= 1) & (count(b) <= 1), None).when((a == one) | (b == one), one).otherwise(merged)


def merge_templates(new: Column, old: Column) -> Column:
    """A template that covers both, or null where there is none; the same template merges to itself."""

    def checked(each: Column) -> Column:
        edits = F.exists(each, lambda e: e["differs"] & e["merged"].isNotNull())
        text = from_answer(F.array_join(F.transform(each, lambda e: F.coalesce(e["merged"], e["own"])), " "))
        return F.when(edits, let(text, lambda m: F.when(is_valid_template(m) & matches_guarded(new, m) & matches_guarded(old, m), m)))

    a, b = template_tokens(new), template_tokens(old)
    each = F.zip_with(a, b, lambda x, y: F.struct(x.alias("own"), F.when(x == y, x).otherwise(merge_tokens(x, y)).alias("merged"), (x != y).alias("differs")))
    return F.when(a == b, new).when(F.size(a) == F.size(b), let(each, checked))


def merge_ids(a: Column, b: Column) -> Column:
    """Sorted union of two arrays of line ids."""
    return F.array_sort(F.array_union(a, b))
