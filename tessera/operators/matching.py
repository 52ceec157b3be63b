"""Joins of lines with templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import constant_length, constant_tokens, matches, parameters, pattern
from ..functions.normalize import normalize_legacy
from ..functions.text import WILDCARD, content, is_valid_template, tokens
from ..plans.storage import keep
from .ranks import ordinals


def _fresh(name: str, *frames: DataFrame) -> str:
    """``name``, longer if a column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _end(parts: Column, k: int) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))


def _ends(first: Column, last: Column) -> Column:
    """Equal for equal kinds and tokens; a token holds no white space."""
    return F.concat(F.coalesce(F.concat(F.lit("="), first), F.lit("*")), F.lit(" "), F.coalesce(F.concat(F.lit("="), last), F.lit("*")))


def _kinds(words: Column) -> list[Column]:
    """The four kinds of ends under which a line looks for templates."""
    none = F.lit(None).cast("string")
    return [_ends(x, y) for x in (_end(words, 1), none) for y in (_end(words, -1), none)]


def _template_ends(parts: Column) -> Column:
    def constant(k: int) -> Column:
        return F.when(F.contains(_end(parts, k), F.lit(WILDCARD)), F.lit(None)).otherwise(_end(parts, k))

    return _ends(constant(1), constant(-1))


def match_templates(lines: DataFrame, templates: DataFrame, keys: tuple[str, ...] = ("n_tokens",), line_col: str = "content") -> DataFrame:
    """Every line with every template that covers it.

    One equi-join decides which meet: its keys are ``keys``, the number of tokens or the bucket, which of a
    template's end tokens are constant, and these tokens. A line stands for itself with each of the four
    kinds of ends, so no line meets a template of other constant ends, and templates few enough to be
    broadcast leave the lines where they are. The pattern, made once for each template, decides the rest. A line of a
    number of tokens only meets templates of that number. Columns may have any name.
    """
    end, words, shape = (_fresh(x, lines, templates) for x in ("ends", "words", "shape"))
    parts = tokens(F.col("template"))
    shapes = templates.where(F.size(parts) > 0).withColumn(end, _template_ends(parts)).withColumn(shape, pattern(F.col("template")))
    named = lines.withColumn(words, tokens(F.col(line_col))).where(F.size(words) > 0).withColumn(end, F.explode(F.array(*_kinds(F.col(words))))).drop(words)
    return named.join(shapes, [*keys, end]).where(matches(F.col(line_col), F.col("template"), F.col(shape))).drop(end, shape)


def first_template(lines: DataFrame, templates: DataFrame, order: str, keys: tuple[str, ...] = ("cid1",), line_col: str = "content") -> DataFrame:
    """``lines`` with found: of the templates that cover a line, the row (``order`` and the other columns but ``keys``) of the smallest ``order``; null without one.

    The same pairs as in `match_templates` are compared, but the templates that a line may meet are lists: lines stay one row each, and
    are neither dealt nor gathered again. A template whose constant tokens a line does not hold is passed over before its pattern is made.
    """
    parts = tokens(F.col("template"))
    rest = [c for c in templates.columns if c not in (*keys, order)]
    shapes = templates.where(F.size(parts) > 0).select(*keys, _template_ends(parts).alias("ends"), F.struct(order, *rest).alias("row"), F.struct(F.col("template").alias("t"), pattern(F.col("template")).alias("shape"), constant_tokens(F.col("template")).alias("must")).alias("test"))
    lists = keep(shapes.groupBy(*keys, "ends").agg(F.collect_list(F.struct("row", "test")).alias("list")))
    words, names = _fresh("words", lines, templates), [_fresh(f"list{k}", lines, templates) for k in range(4)]
    joined = lines.withColumn(words, tokens(F.col(line_col)))
    ends = [_fresh(f"ends{k}", lines, templates) for k in range(4)]
    joined = joined.select(*lines.columns, *[F.when(F.size(words) > 0, e).alias(n) for e, n in zip(_kinds(F.col(words)), ends, strict=True)])
    for end, name in zip(ends, names, strict=True):
        joined = joined.join(lists.withColumnsRenamed({"ends": end, "list": name}), [*keys, end], "left")
    text = F.col(line_col)

    def covers(t: Column) -> Column:
        return F.forall(t["test"]["must"], lambda m: F.contains(content(text), m)) & matches(text, t["test"]["t"], t["test"]["shape"])

    met = F.flatten(F.filter(F.array(*names), lambda x: x.isNotNull()))
    return joined.select(*lines.columns, F.array_min(F.transform(F.filter(met, covers), lambda t: t["row"])).alias("found"))


def unmatched_lines(lines: DataFrame, templates: DataFrame, keys: tuple[str, ...] = ("n_tokens",)) -> DataFrame:
    """Lines that no template covers."""
    return lines.join(match_templates(lines, templates, keys).select("line_id").distinct(), "line_id", "left_anti")


def best_template(lines: DataFrame, templates: DataFrame, keys: tuple[str, ...] = ("n_tokens",)) -> DataFrame:
    """(line_id, content, template, params): the template of most constant characters, then the smaller by name."""
    matched = match_templates(lines, templates, keys)
    best = matched.groupBy("line_id").agg(F.min(F.struct((-constant_length(F.col("template"))).alias("n"), F.col("template").alias("template"), F.col("content").alias("content"))).alias("b"))
    return best.select("line_id", "b.content", "b.template", parameters(F.col("b.content"), F.col("b.template")).alias("params"))


def most_similar(new: DataFrame, known: DataFrame, where: Column | bool = True) -> DataFrame:
    """``new`` with old, sim and the other columns of ``known``: for each new template the most similar known one.

    Both are of one bucket; of equally similar ones the smallest seq counts; ``where`` limits the pairs.
    """
    from ..functions.similarity import smoothed_jaccard
    from ..functions.text import space_tokens

    pairs = new.join(known.withColumnRenamed("template", "old"), "cid1").where(where if isinstance(where, Column) else F.lit(where))
    pairs = pairs.withColumn("sim", smoothed_jaccard(space_tokens(F.col("template")), space_tokens(F.col("old"))))
    rest = [c for c in pairs.columns if c not in ("cid1", "template", "sim", "seq", "old")]
    best = pairs.groupBy("cid1", "template").agg(F.max_by(F.struct("sim", "seq", "old", *rest), F.struct("sim", (-F.col("seq")).alias("s"), "old")).alias("b"))
    return best.select("cid1", "template", "b.*")


def event_ids(labelled: DataFrame) -> DataFrame:
    """Add event_id: E and the rank of the template's first line among templates."""
    firsts = labelled.groupBy("template").agg(F.min("line_id").alias("first_line"))
    numbered = ordinals(firsts, ["first_line", "template"], "place").withColumn("event_id", F.concat(F.lit("E"), (F.col("place") + 1).cast("string")))
    return labelled.join(numbered.select("template", "event_id"), "template")


def template_table(labelled: DataFrame) -> DataFrame:
    """(event_id, template, occurrences), to be sorted by the number in event_id."""
    return labelled.groupBy("event_id", "template").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.regexp_extract("event_id", r"(\d+)", 1).cast("int"))


def sort_templates(templates: DataFrame) -> DataFrame:
    """Longer templates first, then by name: the order in which the first that covers a line is a specific one."""
    return templates.orderBy(F.char_length("template").desc(), "template")


def _natural(event_id: Column) -> Column:
    """Letters, then the number: E3 before E10."""
    return F.struct(F.regexp_extract(event_id, r"^(\D*)", 1), F.coalesce(F.expr("try_cast(regexp_extract(event_id, '([0-9]+)', 1) as bigint)"), F.lit(-1)), event_id)


def correct_templates(templates: DataFrame, user_strings: tuple[str, ...] = ()) -> DataFrame:
    """(event_ids, template) of (event_id, template): the older rules, and the ids, in natural order, that they make one."""
    corrected = templates.select("event_id", normalize_legacy(F.col("template"), user_strings).alias("template"), _natural(F.col("event_id")).alias("place"))
    lists = corrected.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("place", "event_id"))).alias("ids"))  # as many as there are templates
    return lists.select(F.transform("ids", lambda x: x["event_id"]).alias("event_ids"), "template")


def apply_corrections(labelled: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lines with the corrected template and the first id of its group; lines of other ids stay as they are."""
    own, new = (_fresh(x, labelled) for x in ("own", "new"))
    by_id = corrections.select(F.explode("event_ids").alias("event_id"), F.get("event_ids", 0).alias(own), F.col("template").alias(new))
    joined = labelled.join(by_id, "event_id", "left")
    return joined.withColumn("event_id", F.coalesce(own, "event_id")).withColumn("template", F.coalesce(new, "template")).select(labelled.columns)


def label_by_content(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """Lines with the template of the last labelled line of equal content, null without one."""
    last = labelled.groupBy("content").agg(F.max_by("template", "line_id").alias("template"))
    return lines.join(last, "content", "left")


def majority_templates(answers: DataFrame, key: str = "gt", share: float = 0.8, most_wildcards: int = 50) -> DataFrame:
    """(key, majority, first, diverse) of (line_id, key, parsed), one answer a row: `functions/answers.py` over all answers.

    The majority is the most frequent valid template, of equally frequent ones the first; empty if none is
    valid. Diverse are several answers of which at least ``share`` are different.
    """
    counts = answers.groupBy(key, "parsed").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("at"))
    rank = F.when(is_valid_template(F.col("parsed"), most_wildcards), F.struct("n", -F.col("at")))
    return counts.groupBy(key).agg(
        F.coalesce(F.max_by("parsed", rank), F.lit("")).alias("majority"), F.coalesce(F.min_by("parsed", "at"), F.lit("")).alias("first"),
        ((F.sum("n") > 1) & (F.count(F.lit(1)) / F.sum("n") >= share)).alias("diverse"),
    )


def similarity_matrix(lines: DataFrame) -> DataFrame:
    """(a, b, sim) for the pairs of (line_id, content) that share a token; the others have similarity 0.

    Distinct contents meet by their tokens, so only pairs with something in common are made. It is meant
    for templates and samples: where all share a token, the pairs are all pairs.
    """
    own = lines.groupBy("content").agg(F.min("line_id").alias("line_id")).select("line_id", F.array_distinct(tokens(F.col("content"))).alias("words"))
    each = own.select("line_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    pairs = each.alias("x").join(each.alias("y"), F.expr("x.word = y.word and x.line_id < y.line_id")).groupBy(F.col("x.line_id").alias("a"), F.col("y.line_id").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count(F.lit(1)).alias("common"))
    return pairs.select("a", "b", (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("sim"))
