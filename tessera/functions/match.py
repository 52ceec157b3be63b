"""Matching lines against templates, as column expressions.

A template is constant parts with wildcards between. Whether it covers a line is decided from left to right:
each part is sought from where the last one ended, and the first place that is found stays. That is enough, as an
earlier end leaves more to the rest; so no search is ever taken back, and a line costs its length for each part
at most, however many wildcards the template has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WILDCARD, content, let, template_tokens, tokens, wildcard_count

#: Between the parameters of a line while they are one string.
_MARK = "\x01"


def _parts(template: Column) -> Column:
    """The constant parts as regular expressions: a space is white space of any length, m in a row are at least m."""
    t = F.regexp_replace(content(template), "<.{1,5}>", WILDCARD)
    return F.transform(F.split(t, r"<\*>", -1), lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "([^A-Za-z0-9])", r"\\$1"), r"\\ (?=\\ )", r"\\s"), r"\\ ", r"\\s+"))


def _least(parts: Column) -> Column:
    """Parts with as little white space as will do next to a wildcard, which takes the rest of it."""
    last = F.size(parts) - 1

    def one(p: Column, i: Column) -> Column:
        begun = F.when(i > 0, F.regexp_replace(p, r"^((?:\\s)*)\\s\+", r"$1\\s")).otherwise(p)
        return F.when(i < last, F.regexp_replace(begun, r"\\s\+$", r"\\s")).otherwise(begun)

    return F.transform(parts, one)


def _rest(least: Column, begin: Column) -> Column:
    """What follows the wildcard before part number ``begin``."""
    n = F.size(least)
    between = F.array_join(F.transform(F.slice(least, begin + 1, F.greatest(n - 1 - begin, F.lit(0))), lambda p: F.concat(F.lit("(?>.*?"), p, F.lit(")"))), "")
    return F.concat(between, F.lit(".*"), F.element_at(least, -1), F.lit("$"))


def pattern(template: Column) -> Column:
    """The regular expression of a template: parts in possessive order, so it fails in one pass over the line.

    `<` and up to five characters and `>` is a wildcard too, and so, together, are two wildcards with a space
    between. Every space stands for white space of any length. Only line feeds end a line.
    """
    return let(_least(_parts(template)), lambda p: F.when(F.size(p) == 1, F.concat(F.lit("(?d)^"), F.get(p, 0), F.lit("$"))).otherwise(F.concat(F.lit("(?d)^"), F.get(p, 0), _rest(p, F.lit(1)))))


def _lazy(template: Column, wildcard: str) -> Column:
    """Parts with lazy wildcards between: for lines of several lines, where a wildcard must not pass a line feed that a space may."""
    return F.concat(F.lit("(?d)^"), F.array_join(_parts(template), wildcard), F.lit("$"))


def matches(line: Column, template: Column, pattern_of: Column | None = None) -> Column:
    """Equality for a template without wildcard, else the whole line by its pattern.

    ``pattern_of`` may hold the pattern, so that it is made once for a template. The search keeps its last
    pattern compiled, so lines that meet one template after another cost one compilation.
    """
    has, text = F.contains(content(template), F.lit(WILDCARD)), content(line)
    covered = F.regexp_instr(text, pattern_of if pattern_of is not None else pattern(template)) > 0
    several = F.regexp_instr(text, _lazy(template, ".*?")) > 0
    return F.when(~has, text == content(template)).when(F.contains(text, F.lit("\n")), several).otherwise(covered)


def end_tokens_fit(line_tokens: Column, parts: Column) -> Column:
    """The first and the last token of a template, where without wildcard, are the line's."""

    def fits(k: int) -> Column:
        mine, other = F.try_element_at(parts, F.lit(k)), F.try_element_at(line_tokens, F.lit(k))
        return F.contains(mine, F.lit(WILDCARD)) | (mine == other)

    return (F.size(line_tokens) > 0) & (F.size(parts) > 0) & F.coalesce(fits(1) & fits(-1), F.lit(False))


def matches_guarded(line: Column, template: Column) -> Column:
    """End tokens first, then the pattern; never for a blank line or template."""
    return end_tokens_fit(tokens(line), tokens(template)) & matches(line, template)


def constants(template: Column) -> Column:
    return F.filter(tokens(template), lambda t: ~F.contains(t, F.lit(WILDCARD)))


def matches_with_constants(line: Column, template: Column) -> Column:
    """As ``matches_guarded``; all constant tokens must be tokens of the line as well."""
    return matches_guarded(line, template) & (F.size(F.array_except(constants(template), tokens(line))) == 0)


def is_abstract(line: Column, template: Column) -> Column:
    """Whether the template, each wildcard one run of non-space characters, covers the line."""
    escaped = F.regexp_replace(content(template), "([^A-Za-z0-9])", r"\\$1")
    spaced = F.regexp_replace(escaped, r"\\ +", r"\\s+")
    return F.regexp_instr(content(line), F.concat(F.lit("^"), F.replace(spaced, F.lit(r"\<\*\>"), F.lit(r"(\S+?)")), F.lit("$"))) > 0


def capturing_pattern(template: Column) -> Column:
    """A pattern whose groups are what lazy wildcards would take, found without taking back a part.

    White space before a wildcard belongs to the part, as much of it as leaves the rest of the template a match.
    """

    def whole(s: Column) -> Column:
        parts, least, n = s["parts"], s["least"], F.size(s["parts"])

        def one(p: Column, i: Column) -> Column:
            ahead = F.when(F.endswith(p, F.lit(r"\s+")), F.concat(F.lit("(?="), _rest(least, i + 1), F.lit(")"))).otherwise("")
            opened = F.concat(F.when(i == 0, F.lit("(?>")).otherwise(F.lit("(?>(.*?)")), p, ahead, F.lit(")"))
            return F.when(i < n - 1, opened).otherwise(F.concat(F.when(i > 0, F.lit("(.*?)")).otherwise(""), p))

        return F.concat(F.lit("(?d)^"), F.array_join(F.transform(parts, one), ""), F.lit("$"))

    return let(_parts(template), lambda p: let(F.struct(p.alias("parts"), _least(p).alias("least")), whole))


def parameters(line: Column, template: Column, pattern_of: Column | None = None) -> Column:
    """What stands for each wildcard; empty without wildcards and where the line doesn't match.

    One search finds all. Lines of several lines, lines that hold the character 1 and templates with other white space than
    spaces are searched once for each wildcard.
    """
    text, t = content(line), content(template)
    n = wildcard_count(F.regexp_replace(t, "<.{1,5}>", WILDCARD))
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    lazy = _lazy(template, "(.*?)")
    slow = F.transform(places, lambda i: F.call_function("regexp_extract", text, lazy, i))
    joined = F.regexp_replace(text, pattern_of if pattern_of is not None else capturing_pattern(template), F.array_join(F.transform(places, lambda i: F.concat(F.lit("$"), i.cast("string"))), _MARK))
    odd = F.rlike(t, F.lit("[\t\n\x0b\f\r]")) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit(_MARK))
    covered = F.contains(t, F.lit(WILDCARD)) & matches(line, template)
    return F.when(covered & odd, slow).when(covered, F.split(joined, _MARK, -1)).otherwise(F.array().cast("array<string>"))


def constant_tokens(template: Column) -> Column:
    """What a line must hold to be covered: the pieces of a template between white space and wildcards of any form."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(content(template), "<.{1,5}>", WILDCARD), r"\s+|<\*>"), lambda t: t != ""))


def constant_length(template: Column) -> Column:
    """Characters of a template that are no wildcards: what makes it specific."""
    return F.char_length(F.replace(content(template), F.lit(WILDCARD), F.lit("")))


__all__ = ["capturing_pattern", "constant_length", "constant_tokens", "constants", "end_tokens_fit", "is_abstract", "matches", "matches_guarded", "matches_with_constants", "parameters", "pattern", "template_tokens"]
