"""Tokenisers, masks and predicates of log lines, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
#: Tokens that say nothing about an event: articles and the like, names of days and months. Fixed values.
STOP_WORDS = (
    *("a", "an", "and", "i", "ie", "so", "to", "the"),
    *("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"),
    *("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    *("Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
)
#: Whole-string patterns of parameters: URL, IPv4 address, 12-hour time, telephone number, ISO date. Fixed values, as they are given.
COMMON_PARAMETERS = (
    r"^(https?:\/\/)?([a-z0-9]+([\-\.]{1}[a-z0-9]+)*\.[a-z]{2,5})(:[0-9]{1,5})?(\/.*)?$",
    r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    r"^(1[0-2]|0?[1-9]):[0-5][0-9] (AM|PM)$",
    r"^\+?[1-9]\d{1,14}$",
    r"^(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$",
)
#: Delimiters that the punctuation-aware tokeniser keeps apart.
MESSAGE_DELIMITERS = " ,!;:=|\"'[](){}.-+@#$%&"
ASCII_PUNCTUATION = r"!-/:-@\[-`{-~"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def content(line: Column) -> Column:
    """A null line counts as empty."""
    return F.coalesce(line, F.lit(""))


def tokens(line: Column, unicode_whitespace: bool = False) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(content(line), r"(?U)\s+" if unicode_whitespace else r"\s+"), lambda t: t != "")


def space_tokens(line: Column) -> Column:
    """What stands between single spaces, empty strings included."""
    return F.split(content(line), " ")


def template_tokens(template: Column) -> Column:
    """What stands between spaces, without empty strings."""
    return F.filter(space_tokens(template), lambda t: t != "")


def message_tokens(line: Column, delimiters: str = MESSAGE_DELIMITERS) -> Column:
    """Tokens split at delimiters, which are kept, without other punctuation.

    Tokens lose their punctuation but `= | ( )`; a token with a wildcard is a wildcard; empty tokens go and
    neighbouring wildcards are one.
    """
    one = "[" + "".join("\\" + c for c in delimiters) + "]"
    parts = F.split(content(line), f"(?<={one})|(?={one})")
    bare = F.transform(parts, lambda t: F.when(F.contains(t, F.lit(WILDCARD)), WILDCARD).otherwise(F.regexp_replace(F.trim(t), r"[!-'*-/:;<>?@\[-`{}~]", "")))
    kept = F.filter(bare, lambda t: t != "")
    return F.filter(kept, lambda t, i: (t != WILDCARD) | (i == 0) | (F.try_element_at(kept, i.cast("int")) != WILDCARD))


def mask(line: Column, patterns: Iterable[str]) -> Column:
    """Every match of each pattern in turn becomes a wildcard."""
    out = content(line)
    for p in patterns:
        out = F.regexp_replace(out, p, WILDCARD)
    return out


def mask_common_parameters(line: Column) -> Column:
    """A wildcard if the whole string is a URL, an address, a time, a telephone number or a date."""
    return mask(line, COMMON_PARAMETERS)


def mask_hex(line: Column) -> Column:
    return mask(line, ["0x[0-9a-fA-F]+"])


def token_count(line: Column) -> Column:
    return F.size(tokens(line))


def informative_tokens(line: Column) -> Column:
    """Tokens of more than two characters that are no stop words."""
    return F.filter(F.split(content(line), r"\s+"), lambda t: (F.char_length(t) > 2) & ~t.isin(*STOP_WORDS))


def looks_variable(line: Column) -> Column:
    """Whether anything but letters, spaces and `!` is left without the wildcards."""
    return F.rlike(F.replace(content(line), F.lit(WILDCARD), F.lit("")), F.lit("[^ A-Za-z!]"))


def adaptive_sample_size(line: Column, largest: int = 3) -> Column:
    """Lines to compare: one for a short line without values, else the most."""
    return F.when(~looks_variable(line) & (token_count(line) <= 5), 1).otherwise(largest)


def is_rich_word(word: Column) -> Column:
    """A digit, a symbol and an ASCII letter in one word."""
    return F.rlike(word, F.lit("[0-9]")) & F.rlike(word, F.lit(r"\W")) & F.rlike(word, F.lit("[A-Za-z]"))


def wildcard_count(template: Column) -> Column:
    return ((F.char_length(template) - F.char_length(F.replace(template, F.lit(WILDCARD), F.lit("")))) / 3).cast("int")


def is_valid_template(template: Column, most: int = 50) -> Column:
    return (content(template) != "") & (wildcard_count(content(template)) <= most)


def is_too_general(template: Column) -> Column:
    """Nothing but wildcards, spaces and punctuation."""
    return ~F.rlike(F.replace(content(template), F.lit(WILDCARD), F.lit("")), F.lit(f"[^ {ASCII_PUNCTUATION}]"))


def retry_budget(lines: Column, assigned: int) -> Column:
    """One try for a single line of at most 5 tokens, or if all have at most 2; else as assigned."""
    counts = F.transform(lines, token_count)
    short = ((F.size(lines) == 1) & (F.get(counts, 0) <= 5)) | F.forall(counts, lambda n: n <= 2)
    return F.when(short, 1).otherwise(assigned)


def markdown_tables(text: Column) -> Column:
    """The pipe tables of a text: a header row, a separator row and rows of cells each."""
    return F.regexp_extract_all(content(text), F.lit(r"((?:^|\n)\|[^\n]*\|\s*\n\|[-:| ]+\|(?:\s*\n\|[^\n]*\|)*)"), 1)


def markdown_rows(tbl: Column) -> Column:
    """Cells of a pipe table's rows, the header first and without the separator."""
    lines = F.filter(F.transform(F.split(tbl, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.filter(lines, lambda x: ~F.rlike(x, F.lit(r"^\|[-:| ]+\|$")))
    return F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
