"""Requests to a language model and its answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAVOURS = ("full", "no_advice", "no_format")
_TASK = "Find the template that the log messages below share."
_ADVICE = "Values that vary, such as numbers, addresses, paths, names of users and devices, become {placeholders}; words that say what happened stay."
_FORMAT = "Answer with one line for each message, in order: LogTemplate[i]: `template`."


def request(lines: Column, flavour: str = "full", examples: tuple[tuple[str, str], ...] = ()) -> Column:
    """Chat messages (role, content) that ask for the templates of an array of lines, each in back-ticks."""
    if flavour not in FLAVOURS:
        raise ValueError(f"flavour must be one of {FLAVOURS}")
    system = " ".join(x for x, left_out in ((_TASK, False), (_ADVICE, flavour == "no_advice"), (_FORMAT, flavour == "no_format")) if not left_out)
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("Log["), (i + 1).cast("string"), F.lit("]: `"), x, F.lit("`"))), "\n")

    def message(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    shown = [m for q, a in examples for m in (message("user", F.lit(f"Log[1]: `{q}`")), message("assistant", F.lit(f"LogTemplate[1]: `{a}`")))]
    return F.array(message("system", F.lit(system)), *shown, message("user", numbered))


def parse_answer(answer: Column) -> Column:
    """Array of (idx, template) of an answer's lines that name a template; idx is -1 without number.

    A line may begin with LogTemplate or Log template, with a number in brackets or without; one space
    after the colon and back-ticks around the template go.
    """
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    named = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^(LogTemplate:|LogTemplate\[[0-9]+\]: |Log template: |Log template\[[0-9]+\]: )")))

    def parsed(x: Column) -> Column:
        number = F.regexp_extract(x, r"\[([0-9]+)\]", 1)
        body = F.regexp_replace(x, r"^(LogTemplate:|LogTemplate\[[0-9]+\]:|Log template:|Log template\[[0-9]+\]:) ?", "")
        return F.struct(F.when(number == "", -1).otherwise(F.try_to_number(number, F.lit("999999999")).cast("int")).alias("idx"), F.regexp_replace(body, "^`+|`+$", "").alias("template"))

    return F.transform(named, parsed)


def fill_in(parsed: Column, lines: Column) -> Column:
    """A template for each line by its number from 1; the first template where its own is missing; the lines without any."""
    good = F.array_sort(F.filter(parsed, lambda p: p["idx"] >= 0))
    first = F.get(good, 0)["template"]

    def of(i: Column) -> Column:
        return F.coalesce(F.get(F.filter(good, lambda p: p["idx"] == i + 1), 0)["template"], first)

    return F.when(F.size(good) == 0, lines).otherwise(F.transform(lines, lambda _, i: of(i)))


def plain_answer(answer: Column) -> Column:
    return F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")


def majority(templates: Column, most_wildcards: int = 50) -> Column:
    """The most frequent valid template of an array, the first on ties; empty if none is valid."""
    from .text import is_valid_template

    valid = F.filter(templates, lambda t: is_valid_template(t, most_wildcards))
    counted = F.transform(valid, lambda t, i: F.struct((-F.size(F.filter(valid, lambda u: u == t))).alias("n"), i.alias("i"), t.alias("t")))
    return F.coalesce(F.array_min(counted)["t"], F.lit(""))


def first_template(templates: Column) -> Column:
    return F.coalesce(F.get(templates, 0), F.lit(""))


def is_diverse(templates: Column, share: float = 0.8) -> Column:
    """More than one template, and nearly all different: worth another question."""
    return (F.size(templates) > 1) & (F.size(F.array_distinct(templates)) / F.size(templates) >= share)


def aligned_template(lines: Column) -> Column:
    """The offline answer: tokens that all lines have at a position, a wildcard elsewhere.

    ``lines`` are token arrays of one length; the result is joined by single spaces and not normalised.
    """
    first = F.get(lines, 0)
    return F.array_join(F.transform(first, lambda t, i: F.when(F.forall(lines, lambda x: F.get(x, i) == t), t).otherwise("<*>")), " ")
