"""Operator 12: fill-in-middle transformation, with DataFrame functions only.

1. Every text is cut into its lines, the units, by ``regexp_extract_all``.
2. Digits of a SHA-256 of the seed and the document's id say, by ``conv``, where the two cuts are, whether a document
   is transformed at all and into which form: the same on every machine and in every run.
3. ``slice`` and ``array_join`` make prefix, middle and suffix; sentinels tell them apart in the output.
4. ``restored`` reads the sentinels back and gives the text from output and form alone.

A row is transformed where it is read: nothing is shuffled, counted or collected.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import table

#: A line with its line feed, or what is left at the end.
UNIT = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """What stands before the prefix, the suffix and the middle in the output.

    The first character of each may stand nowhere else in any of them and none may begin another: then neither
    a text's end and a sentinel nor a sentinel and a text's start make another sentinel, and texts without
    sentinels come back as they were.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        each = astuple(self)
        if not all(each) or len(set(each)) < 3 or any(s[0] in t[1:] or s != t and t.startswith(s) for s in each for t in each):
            raise ValueError("sentinels must not be empty, begin one another or hold another's first character")

    def pattern(self) -> str:
        """A regular expression of any of them."""
        return "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in astuple(self))


def group(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 1, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text of an output; null for an output that its form does not fit."""
    parts = F.split(output, sentinels.pattern(), -1)
    first, second, third = (F.get(parts, k) for k in (1, 2, 3))
    fits = (F.size(parts) == 4) & (F.get(parts, 0) == "")
    return F.when(form == PLAIN, output).when(fits & (form == PSM), F.concat(first, third, second)).when(fits & (form == SPM), F.concat(second, third, first))


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, sentinels: Sentinels = Sentinels(), unit: str = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rearrange texts so that a model learns to fill in their middles.

    Returns id, text, n (units), form, prefix, middle, suffix and output. ``rate`` percent of the documents are
    cut, by their ids, of which ``spm_rate`` percent have their suffix first; the others, empty and null texts
    and texts that hold a sentinel are ``plain``: their output is the text, their parts are null. A null text
    counts as empty, a null id as an empty one; rows that repeat an id are cut by the same numbers, each in its
    own text; an empty table gives an empty result; other columns are ignored. A text of a single unit has
    empty parts besides it, so no text is dropped for being short.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)).withColumn("units", F.regexp_extract_all("text", F.lit(unit), 0)).withColumn("n", F.size("units"))
    h1, h2, h3, h4 = (group(F.col("digest"), k) for k in (1, 2, 3, 4))
    n, stays = F.col("n"), (F.col("text") == "") | F.rlike("text", F.lit(sentinels.pattern())) | (h3 % 100 >= rate)
    cut = drawn.select("id", "text", "units", n.cast("long").alias("n"), F.when(stays, PLAIN).when(h4 % 100 < spm_rate, SPM).otherwise(PSM).alias("form"), F.least(h1 % (n + 1), h2 % (n + 1)).cast("int").alias("a"), F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int").alias("b"))

    def units(first: Column, last: Column) -> Column:
        return F.when(F.col("form") != PLAIN, F.array_join(F.slice("units", first + 1, last - first), ""))

    parts = cut.select("id", "text", "n", "form", units(F.lit(0), F.col("a")).alias("prefix"), units(F.col("a"), F.col("b")).alias("middle"), units(F.col("b"), F.col("n").cast("int")).alias("suffix"))
    p, s, m = (F.lit(x) for x in astuple(sentinels))
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return parts.withColumn("output", F.when(F.col("form") == PLAIN, F.col("text")).when(F.col("form") == PSM, psm).otherwise(spm)).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
