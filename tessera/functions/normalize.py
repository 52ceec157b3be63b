"""Normalisation of templates, as column expressions: one pass for each rule, no loops.

A rule that shrinks a chain (`V.V.V` to `V`) is one replacement of the whole chain; a rule with a space on
both sides uses a look-ahead for the second one, so that neighbours share it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WILDCARD, content, is_too_general, let, mask

_V = r"<\*>"
#: Characters at which tokens are cut, white space aside. Fixed values.
DELIMITERS = ",!;:=|\"'[](){}.-+@#$%&"
_CUT = r"[\s" + "".join("\\" + c for c in DELIMITERS) + "]"


def _chain(t: Column, link: str) -> Column:
    return F.regexp_replace(t, f"{_V}(?:{link}{_V})+", WILDCARD)


def _between(t: Column, inner: str) -> Column:
    """`·inner·` to `·V·`."""
    return F.regexp_replace(t, f" {inner}(?= )", f" {WILDCARD}")


def fixpoint(t: Column, old: str, new: str) -> Column:
    """Replace until nothing changes; ``new`` must be shorter, so the text's length bounds the steps."""
    return let(t, lambda t: F.when(F.contains(t, F.lit(old)), F.aggregate(F.sequence(F.lit(1), F.char_length(t)), t, lambda s, i: F.replace(s, F.lit(old), F.lit(new)))).otherwise(t))


def squeeze(t: Column) -> Column:
    """No white space at the ends, one space elsewhere."""
    return F.regexp_replace(F.regexp_replace(content(t), r"^\s+|\s+$", ""), r"\s+", " ")


def _token(t: Column) -> Column:
    number = F.rlike(t, F.lit("^[0-9]+$")) | F.rlike(t, F.lit("^0x[0-9a-fA-F]+"))
    return F.when(number, WILDCARD).otherwise(let(fixpoint(t, "0x<*>", WILDCARD), lambda t: F.when(F.rlike(t, F.lit(rf"^[^\s/]*{_V}[^\s/]*$")), WILDCARD).otherwise(t)))


def normalize_tokens(t: Column) -> Column:
    """Tokens that are numbers, begin as hexadecimal numbers or hold a wildcard become wildcards."""
    return F.array_join(F.transform(F.split(t, f"(?<={_CUT})|(?={_CUT})"), _token), "")


def normalize_chains(t: Column) -> Column:
    """Neighbouring wildcards, alone or with punctuation between or around them, become one."""
    t = _chain(t, r"\.")
    t = F.regexp_replace(t, f"(?:{_V})+", WILDCARD)
    t = _between(t, rf"#{_V}#")
    t = _between(t, rf"#{_V}")
    for link in (":", "#", "/", "@", r"\."):
        t = _chain(t, link)
    for quote in ('"', "'"):
        t = _between(t, f"{quote}{_V}{quote}")
    t = F.regexp_replace(t, f"(?:{_V})+", WILDCARD)
    t = _between(t, rf"{_V}\.")
    t = _between(t, f"{_V},")
    t = _chain(t, r"\+")
    t = _chain(t, "##")
    t = fixpoint(t, "#<*>#", WILDCARD)
    t = _chain(t, "-")
    t = F.regexp_replace(t, f" {_V}(?: {_V})+(?= )", f" {WILDCARD}")
    t = F.regexp_replace(t, f" {_V}(?: {_V})+$", f" {WILDCARD}")
    t = F.regexp_replace(t, f"^{_V} (?:{_V} )+", f"{WILDCARD} ")
    t = _chain(t, ",")
    t = F.regexp_replace(t, rf"\({_V}(?: {_V})+\)", f"({WILDCARD})")
    t = _between(t, f"/{_V}")
    return F.regexp_replace(t, f" /{_V}$", f" {WILDCARD}")


def normalize_pairs(t: Column) -> Column:
    """With three `=V` or more, every `= ` gets the wildcard that is missing."""

    def filled(t: Column) -> Column:
        many = (F.char_length(t) - F.char_length(F.replace(t, F.lit("=<*>"), F.lit("")))) >= 12
        return F.when(many, F.replace(t, F.lit("= "), F.lit("=<*> "))).otherwise(t)

    return let(t, filled)


def normalize(template: Column) -> Column:
    """All rules for a template whose placeholders are wildcards already."""
    return normalize_pairs(normalize_chains(normalize_tokens(squeeze(template))))


def placeholders(answer: Column) -> Column:
    """`{{x}}` and `{x}` to wildcards."""
    return mask(answer, [r"\{\{.*?\}\}", r"\{.*?\}"])


def from_answer(answer: Column, patterns: Iterable[str] = ()) -> Column:
    """An answer as a template: placeholders, extra masks, all rules; empty if nothing constant is left."""
    return let(normalize(mask(placeholders(answer), patterns)), lambda t: F.when(is_too_general(t), "").otherwise(t))


def normalize_legacy(template: Column, user_strings: Iterable[str] = ()) -> Column:
    """The older rules: paths, booleans and given strings become wildcards; no hexadecimal numbers, fewer chains."""
    words = [x.lower() for x in ("true", "false", "null", "root", "admin", *user_strings)]
    t = squeeze(template)
    cut = r"[\s,!;:=|\"'\[\](){}]"
    t = F.array_join(F.transform(F.split(t, f"(?<={cut})|(?={cut})"), lambda p: F.when(F.rlike(p, F.lit(r"^(/[^/]+)+$")), WILDCARD).otherwise(p)), "")

    def token(p: Column) -> Column:
        named = F.lower(p).isin(*words) | F.rlike(p, F.lit("^[0-9]+$"))
        return F.when(named | F.rlike(p, F.lit(rf"^[^\s/]*{_V}[^\s/]*$")), WILDCARD).otherwise(p)

    t = F.array_join(F.transform(F.split(t, f"(?<={_CUT})|(?={_CUT})"), token), "")
    return F.regexp_replace(_chain(t, r"\."), f"(?:{_V})+", WILDCARD)
