"""Matching by a prefix tree of templates, whose wildcards take any number of tokens.

The tree is a table: a node is a template's beginning up to one of its wildcards, an edge adds the constant tokens up to
the next one. Lines walk it as a frontier of (line, node, place) rows. Each step is one equi-join: on the line's
beginning at the root, below it on the node and the first token of what comes next; the edge's tokens are then
sought from the place on, and the first place where they stand is enough, as an earlier end leaves more to
the wildcard. So there are as many steps as a template has wildcards, and a line is at a node once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WILDCARD, message_tokens
from ..plans.storage import keep

#: Stands before, between and after tokens.
CUT = "\x01"
Tokenise = Callable[[Column], Column]


def _joined(words: Column) -> Column:
    """Tokens as one string, each between two cuts; a single cut without any."""
    return F.concat(F.lit(CUT), F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(CUT))), ""))


def _token(part: Column, place: int) -> Column:
    """The first (1) or last (-2) token of a joined string, empty without any."""
    return F.coalesce(F.try_element_at(F.split(part, CUT), F.lit(2 if place == 1 else place)), F.lit(""))


@dataclass(frozen=True)
class Tree:
    """``inner``: (parent, node, part, head), edges that end before a wildcard; ``ends``: (parent, part, tail, template),
    what stands after a template's last wildcard, or all of it; ``below``: (node, template); ``depth``: steps of a walk.
    """

    inner: DataFrame
    ends: DataFrame
    below: DataFrame
    depth: int
    longest: int


def template_tree(templates: DataFrame, tokenise: Tokenise = message_tokens) -> Tree:
    """The tree of (template); wildcards in a row are one; templates that are null, have no token or occur again add nothing."""
    words = tokenise(F.col("template"))
    once = F.filter(words, lambda w, i: (w != WILDCARD) | (i == 0) | (F.get(words, i - 1) != WILDCARD))
    parts = templates.select("template").where(F.size(words) > 0).distinct().withColumn("parts", F.split(_joined(once), r"<\*>", -1)).withColumn("last", F.size("parts") - 1)
    each = keep(parts.select("template", "last", "parts", F.posexplode("parts").alias("k", "part")))

    def upto(k: Column) -> Column:
        """A node's name: its parts with wildcards between; the root's is empty."""
        return F.array_join(F.slice("parts", F.lit(1), k), WILDCARD)

    named = keep(each.select("template", "k", "last", "part", upto(F.col("k")).alias("parent"), upto(F.col("k") + 1).alias("node")))
    before = named.where("k < last")
    bounds = before.agg(F.coalesce(F.max("k") + 1, F.lit(0)).alias("depth"), F.coalesce(F.max(F.when(F.col("k") == 0, F.size(F.split("part", CUT)) - 2)), F.lit(0)).alias("longest")).first()
    inner = before.select("parent", "node", "part", _token(F.col("part"), 1).alias("head")).distinct()
    ends = named.where("k = last").select("parent", "part", _token(F.col("part"), -2).alias("tail"), "template")
    return Tree(keep(inner), keep(ends), before.select("node", "template"), bounds.depth, bounds.longest)


def walk(lines: DataFrame, tree: Tree, tokenise: Tokenise = message_tokens) -> tuple[DataFrame, DataFrame]:
    """((line_id, template, params) of every match, (line_id, node, parent) of every node that a line reaches).

    params are what the wildcards take, without the white space between tokens.
    """
    text = keep(lines.select("line_id", _joined(tokenise(F.col("content"))).alias("text")).where(F.length("text") > 1))
    size = F.size(F.split("text", CUT)) - 2
    starts = text.withColumn("n", F.explode(F.sequence(F.lit(0), F.least(size, F.lit(tree.longest))))).withColumn("part", F.concat(F.expr("substring_index(text, chr(1), n + 1)"), F.lit(CUT)))
    none = F.array().cast("array<string>")
    first = starts.join(tree.inner.where("parent = ''").select("node", "part"), "part").select("line_id", "text", F.lit("").alias("parent"), "node", F.length("part").alias("at"), none.alias("params"))
    frontier = keep(first)
    reached = [frontier]
    for _ in range(tree.depth - 1):
        rest = F.array_distinct(F.split(F.expr("substr(text, at + 1)"), CUT))
        asked = frontier.withColumn("head", F.explode(rest)).withColumnRenamed("parent", "before").withColumnRenamed("node", "parent")
        found = asked.join(tree.inner.where("parent != ''"), ["parent", "head"]).withColumn("place", F.expr("locate(part, text, at)")).where("place > 0")
        taken = F.replace(F.expr("substr(text, at, place - at)"), F.lit(CUT), F.lit(""))
        frontier = keep(found.select("line_id", "text", "parent", "node", (F.col("place") + F.length("part") - 1).alias("at"), F.concat("params", F.array(taken)).alias("params")))
        reached.append(frontier)
    every = reached[0]
    for more in reached[1:]:
        every = every.unionByName(more)
    closing = every.withColumn("tail", F.explode(F.array_distinct(F.array(_token(F.col("text"), -2), F.lit("")))))
    final = closing.select("line_id", "text", "at", "params", "tail", F.col("node").alias("parent")).join(tree.ends.where("parent != ''"), ["parent", "tail"])
    place = F.when(F.col("tail") == "", F.length("text")).otherwise(F.length("text") - F.length("part") + 1)
    fits = (F.col("tail") == "") | (F.endswith("text", F.col("part")) & (place >= F.col("at")))
    last = F.replace(F.substr("text", F.col("at"), place - F.col("at")), F.lit(CUT), F.lit(""))
    by_wildcard = final.where(fits).select("line_id", "template", F.concat("params", F.array(last)).alias("params"))
    exact = text.join(tree.ends.where("parent = ''").select(F.col("part").alias("text"), "template"), "text").select("line_id", "template", none.alias("params"))
    return by_wildcard.unionByName(exact), every.select("line_id", "node", "parent")


def match_tree(lines: DataFrame, templates: DataFrame, tokenise: Tokenise = message_tokens) -> DataFrame:
    """(line_id, template, matched, params) of (line_id, content).

    A line that templates cover has one row: that with most constant tokens, then fewest wildcards, then the first by name.
    A line that none covers has a row, not matched, for each relevant template: those below the nodes where its
    walk ended. Lines that are null, blank or at no node have no row, nor have templates without tokens.
    """
    tree = template_tree(templates, tokenise)
    found, reached = walk(lines, tree, tokenise)
    found, reached = keep(found), keep(reached)
    words = tokenise(F.col("template"))
    wild = F.size(F.filter(words, lambda w: w == WILDCARD))
    ranks = templates.select("template").where("template is not null").distinct().select("template", wild.alias("wild"), (F.size(words) - wild).alias("constant"))
    best = found.join(ranks, "template").groupBy("line_id").agg(F.min(F.struct((-F.col("constant")).alias("c"), "wild", "template", "params")).alias("b"))
    matched = best.select("line_id", "b.template", F.lit(True).alias("matched"), "b.params")
    ended = reached.join(reached.select("line_id", F.col("parent").alias("node")), ["line_id", "node"], "left_anti").join(found.select("line_id"), "line_id", "left_anti")
    relevant = ended.join(tree.below, "node").select("line_id", "template", F.lit(False).alias("matched"), F.lit(None).cast("array<string>").alias("params")).distinct()
    return matched.unionByName(relevant)
