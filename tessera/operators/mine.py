"""Template mining in rounds, every round a few joins over all clusters of all buckets at once.

In a round each cluster of lines without template samples contrasting lines and induces a template. Larger
clusters of a bucket come first: where the anchor is covered by the template of an earlier one, or the
template is to merge with one of this round or with a known one that an earlier one merges with, the
cluster waits for the next round. The others' templates label every pending line of the bucket that they
cover, the earliest if several do; a template that is close to a known one of its bucket merges with it.
There are as many rounds as a cluster has templates, not as many as a bucket has. Lines that are labelled
are written once, and again only when templates merge.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import aligned_template, fill_in, majority, parse_answer, request
from ..functions.match import end_tokens_fit, matches, matches_guarded, pattern
from ..functions.merge import may_merge, merge_templates
from ..functions.normalize import from_answer
from ..functions.text import is_valid_template, mask, retry_budget, template_tokens, tokens, wildcard_count
from ..plans.storage import keep
from ..sources.presets import PRESETS
from .cluster import MIN_CLUSTER, TOP_TOKENS, cluster_lines
from .matching import event_ids, first_template, match_templates, most_similar
from .sampling import MIN_SIMILARITY, PER_LEVEL, SAMPLE_SIZE, WEIGHT, contrast_samples

#: A connection to a model: chat messages (role, content) and a temperature in, the answer's text out.
Client = Callable[[list[dict[str, str]], float], str]


class Memory(Protocol):
    """Where tasks keep answers by the digest of their requests, such as a key-value store that all executors reach."""

    def get(self, digest: str) -> str | None: ...

    def put(self, digest: str, answer: str) -> None: ...


@dataclass(frozen=True)
class FolderMemory:
    """Answers as files of a folder that all executors mount; a file is whole or not there."""

    path: str

    def get(self, digest: str) -> str | None:
        try:
            with open(os.path.join(self.path, digest), encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, digest: str, answer: str) -> None:
        os.makedirs(self.path, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.path, encoding="utf-8", delete=False) as f:
            f.write(answer)
        os.replace(f.name, os.path.join(self.path, digest))


@dataclass(frozen=True)
class RemoteInducer:
    """A language model that is asked for templates, several questions of a task at once.

    ``connect`` makes a client once in every task; ``in_flight`` of its questions are open at a time, so the client must
    bear calls from several threads. Equal questions are asked once. A question that fails is repeated ``attempts``
    times in all, after ``wait`` seconds more each time, and then has no answer. ``memory`` makes a `Memory` once in every
    task: an answer is put there as soon as it is given, so a task that runs again, or a later run with the same
    questions, asks only what has no answer yet. Answers that are no template of the anchor are asked for again at a higher
    temperature, as often as ``retry_budget`` gives the sample of ``tries``.
    """

    connect: Callable[[], Client]
    flavour: str = "full"
    attempts: int = 3
    wait: float = 1.0
    tries: int = 3
    temperature: float = 0.0
    again: float = 0.7
    in_flight: int = 8
    memory: Callable[[], Memory] | None = None

    def ask(self, samples: DataFrame, temperature: float, turn: int = 0) -> DataFrame:
        """``samples`` with ``answer``, the majority of the templates that the model gives for (asked) lines.

        Adds ``queries`` and ``seconds``, the calls of the client for this sample and their time, to those so far. ``turn`` says how
        often the sample has been asked before: another turn is another question.
        """
        connect, attempts, wait, in_flight, memory = self.connect, self.attempts, self.wait, self.in_flight, self.memory

        def one(client: Client, store: Memory | None, digest: str, messages: str) -> tuple[str, int, float]:
            if store is not None and (kept := store.get(digest)) is not None:
                return kept, 0, 0.0
            began = time.monotonic()
            for k in range(attempts):
                try:
                    answer = client(json.loads(messages), temperature)
                    if store is not None:
                        store.put(digest, answer)
                    return answer, k + 1, time.monotonic() - began
                except Exception:
                    time.sleep(wait * k)
            return "", attempts, time.monotonic() - began

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client, store = connect(), memory() if memory is not None else None
            with ThreadPoolExecutor(in_flight) as pool:
                for batch in batches:
                    told = list(pool.map(lambda x: one(client, store, *x), zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
                    columns = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.string(), pa.int32(), pa.float64()), strict=True)] if told else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["digest", "told", "calls", "took"])

        rows = keep(samples.withColumn("messages", F.to_json(request(F.col("asked"), self.flavour))).withColumn("digest", F.sha2(F.concat_ws("\x00", F.lit(f"{temperature} {turn}"), "messages"), 256)))
        told = keep(rows.groupBy("digest").agg(F.first("messages").alias("messages")).mapInArrow(run, "digest string, told string, calls int, took double"))  # asked once
        answered = rows.join(told, "digest").withColumn("answer", from_answer(majority(fill_in(parse_answer(F.col("told")), F.col("asked")))))
        return answered.withColumn("queries", F.col("queries") + F.col("calls")).withColumn("seconds", F.col("seconds") + F.col("took")).drop("messages", "digest", "told", "calls", "took")


#: An inducer makes a column of answers from a column of sampled lines, or asks a model.
Inducer = Callable[[Column], Column] | RemoteInducer


@dataclass(frozen=True)
class Settings:
    """How to mine: `mine_templates(lines, **settings.options())`.

    ``masks`` says where a preset's patterns go: into the lines before all else, into the questions to the
    model only, or nowhere.
    """

    patterns: tuple[str, ...] = ()
    masks: str = "before"
    k: int = TOP_TOKENS
    min_size: int = MIN_CLUSTER
    seed: int | None = None
    sample_size: int = SAMPLE_SIZE
    min_similarity: float = MIN_SIMILARITY
    weight: float = WEIGHT
    per_level: int = PER_LEVEL

    @classmethod
    def of(cls, preset: str, **changes) -> Settings:
        """Those of a known kind of logs."""
        return cls(patterns=tuple(PRESETS[preset].masks), **changes)

    def options(self) -> dict:
        if self.masks not in ("before", "query", "none"):
            raise ValueError("masks must be before, query or none")
        sampled = {"size": self.sample_size, "min_similarity": self.min_similarity, "weight": self.weight, "per_level": self.per_level}
        return {"sampling": sampled, "patterns": self.patterns if self.masks == "before" else (), "query_patterns": self.patterns if self.masks == "query" else (), "k": self.k, "min_size": self.min_size, "seed": self.seed}


def offline(sample: Column) -> Column:
    """Tokens that all sampled lines share by position; they have equally many."""
    return aligned_template(F.transform(sample, lambda x: tokens(x)))


def induced(samples: DataFrame, inducer: Inducer, query_patterns: tuple[str, ...] = ()) -> DataFrame:
    """(cid1, cid2, anchor, template, sample, answer, queries, seconds): the answer, else the anchor normalised, else the anchor itself.

    An answer counts if it is valid and covers the anchor, so each round labels a line at least.
    ``query_patterns`` mask what the inducer sees, not the lines. queries and seconds are those of a model, 0 without one.
    """
    anchor = F.col("anchor")

    def good(t: Column) -> Column:
        return is_valid_template(t) & matches_guarded(anchor, t)

    asked = samples.withColumn("asked", F.transform(F.col("sample"), lambda x: mask(x, query_patterns))).withColumn("queries", F.lit(0)).withColumn("seconds", F.lit(0.0))
    if isinstance(inducer, RemoteInducer):
        answers = inducer.ask(asked, inducer.temperature)
        for k in range(1, inducer.tries):
            weak = ~F.coalesce(good(F.col("answer")), F.lit(False)) & (retry_budget(F.col("asked"), inducer.tries) > k)
            answers = keep(answers.where(~weak).unionByName(inducer.ask(answers.where(weak).drop("answer"), inducer.again, k)))
    else:
        answers = asked.withColumn("answer", from_answer(inducer(F.col("asked"))))
    answers = answers.withColumn("own", from_answer(anchor))

    return answers.select("cid1", "cid2", "anchor", F.when(good(F.col("answer")), F.col("answer")).when(good(F.col("own")), F.col("own")).otherwise(anchor).alias("template"), "sample", "answer", "queries", "seconds")


def mine_templates(lines: DataFrame, patterns: tuple[str, ...] = (), k: int = TOP_TOKENS, min_size: int = MIN_CLUSTER, inducer: Inducer = offline, seed: int | None = None, query_patterns: tuple[str, ...] = (), sampling: dict | None = None) -> DataFrame:
    """Label each line of (line_id, content) with a template; see ``mine_with_trace``."""
    return mine_with_trace(lines, patterns, k, min_size, inducer, seed, query_patterns, sampling)[0]


def usage(trace: DataFrame) -> DataFrame:
    """(inductions, queries, seconds, mean_seconds): what a run has asked of a model, over all that it took."""
    sums = trace.agg(F.count(F.lit(1)).alias("inductions"), F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    return sums.withColumn("mean_seconds", F.when(F.col("queries") > 0, F.col("seconds") / F.col("queries")).otherwise(0.0))


def first_of_equals(asked: DataFrame) -> DataFrame:
    """One row for each template of a bucket, with ``rank``, its order in the bucket: the largest cluster first."""
    distinct = asked.withColumn("again", F.row_number().over(W.partitionBy("cid1", "template").orderBy(F.desc("size"), "cid2"))).where("again = 1").drop("again")
    return distinct.withColumn("rank", F.row_number().over(W.partitionBy("cid1").orderBy(F.desc("size"), "cid2")))


def accepted(new: DataFrame, known: DataFrame | None) -> DataFrame:
    """(cid1, rank, template, old, merged) of the templates of ``first_of_equals`` that this round takes.

    The first one of each bucket always is among them. old is the known template that merged replaces.
    """
    other = new.select("cid1", F.col("rank").alias("before"), "template")
    covered = match_templates(new.select("cid1", "rank", "anchor"), other, ("cid1",), "anchor").where("before < rank").select("cid1", "rank").distinct()
    open_ones = keep(new.join(covered, ["cid1", "rank"], "left_anti").select("cid1", "rank", "template"))
    mates = open_ones.select("cid1", F.col("template"), F.col("rank").alias("seq"))
    mates = mates.withColumn("known", F.lit(False)) if known is None else mates.withColumn("known", F.lit(False)).unionByName(known.select("cid1", "template", "seq").withColumn("known", F.lit(True)))
    near = most_similar(open_ones, mates.withColumn("seq", F.when(F.col("known"), F.col("seq") - (1 << 62)).otherwise(F.col("seq"))), F.expr("known or seq < rank"))
    near = near.where(may_merge(F.col("template"), F.col("old")) & (F.size(template_tokens(F.col("template"))) > 1)).withColumn("merged", merge_templates(F.col("template"), F.col("old"))).where("merged is not null")
    waits = near.where("not known").select("cid1", "rank")
    merging = near.where("known").withColumn("turn", F.row_number().over(W.partitionBy("cid1", "old").orderBy("rank")))
    waits = waits.unionByName(merging.where("turn > 1").select("cid1", "rank"))
    taken = open_ones.join(waits, ["cid1", "rank"], "left_anti").join(merging.where("turn = 1").select("cid1", "rank", "old", "merged"), ["cid1", "rank"], "left")
    return taken.withColumn("merged", F.coalesce("merged", "template"))


def mine_with_trace(lines: DataFrame, patterns: tuple[str, ...] = (), k: int = TOP_TOKENS, min_size: int = MIN_CLUSTER, inducer: Inducer = offline, seed: int | None = None, query_patterns: tuple[str, ...] = (), sampling: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled lines (line_id, content, template, event_id), and a trace (iter, cid1, sample, answer, template, queries, seconds) of each induction.

    ``patterns`` mask values first, in the lines themselves; ``query_patterns`` only in what the inducer
    sees; ``sampling`` holds options of `contrast_samples`. A null line counts as empty; blank lines and lines of more than fifty
    wildcards are templates of their own; equal lines have equal templates; an empty table gives an empty
    result.
    """
    labelled, trace, _ = mine_with_lineage(lines, patterns, k, min_size, inducer, seed, query_patterns, sampling)
    return event_ids(labelled.select("line_id", "content", "template")).select("line_id", "content", "template", "event_id"), trace


def mine_with_lineage(lines: DataFrame, patterns: tuple[str, ...] = (), k: int = TOP_TOKENS, min_size: int = MIN_CLUSTER, inducer: Inducer = offline, seed: int | None = None, query_patterns: tuple[str, ...] = (), sampling: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled lines (line_id, content, template, entry), the trace, and the entries of the template database.

    An entry is a template of a bucket as a round has added it: (cid1, entry, template, round, parent, root,
    root_template). parent is the entry that a merge has replaced it by, root the last one on that path, itself without
    a merge. Lines keep the entry of the template that covers them: those that a merged template does not cover stay
    with the old one, whose root says what it has become. Lines that need no induction have no entry.
    """
    labelled, trace, entries = mine_rounds(lines, patterns, k, min_size, inducer, seed, query_patterns, sampling)
    return labelled, trace, merge_forest(entries.drop("n_tokens"))


def mine_rounds(
    lines: DataFrame, patterns: tuple[str, ...] = (), k: int = TOP_TOKENS, min_size: int = MIN_CLUSTER, inducer: Inducer = offline, seed: int | None = None, query_patterns: tuple[str, ...] = (), sampling: dict | None = None,
    earlier: DataFrame | None = None, first_round: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled lines and trace as `mine_with_lineage`, and new entries (cid1, n_tokens, entry, template, round, replaces).

    ``earlier`` (n_tokens, template, entry) are templates of other lines that new ones may merge with; the lines here are taken
    to be covered by none. Rounds and entries are counted from ``first_round`` on.
    """
    masked = lines.select("line_id", mask(F.col("content"), patterns).alias("content"))
    clustered = keep(cluster_lines(masked, k, min_size))
    odd = (F.col("n_tokens") == 0) | (wildcard_count(F.col("content")) > 50)
    labelled = clustered.where(odd).select("content", "cid1", "first_line", "weight", F.col("content").alias("template"), F.lit(None).cast("long").alias("entry"))
    pending = clustered.where(~odd)
    known, seq, steps, rounds = None, first_round, [], []
    buckets = clustered.select("cid1", "n_tokens").distinct()
    if earlier is not None:
        known = keep(earlier.join(buckets, "n_tokens").select("cid1", "template", F.col("entry").alias("seq")))
    while pending.limit(1).count():
        sizes = pending.groupBy("cid2").agg(F.sum("weight").alias("size"))
        asked = keep(induced(contrast_samples(pending, seed=seed, **(sampling or {})), inducer, query_patterns).join(sizes, "cid2").withColumn("iter", F.lit(seq)))
        first = keep(first_of_equals(asked))
        final = keep(accepted(first, known).withColumn("entry", (F.lit(seq * (1 << 20)) + F.col("rank")).cast("long")))
        steps.append(first.join(final.select("cid1", "rank"), ["cid1", "rank"], "left_semi"))
        both = final.select("cid1", "rank", "template", "merged", "entry").unionByName(final.where("merged != template").select("cid1", "rank", F.col("merged").alias("template"), "merged", "entry"))
        seen = keep(first_template(pending, both, "rank"))
        found = seen.where("found is not null").select("content", "cid1", "first_line", "weight", F.col("found.merged").alias("template"), "found.entry")
        merging = final.where("old is not null")
        if merging.limit(1).count():  # lines of a template that has merged follow it if it covers them
            new = merging.select("cid1", F.col("old").alias("template"), "merged", F.col("entry").alias("next"), pattern(F.col("merged")).alias("shape"))
            moved = labelled.join(new, ["cid1", "template"], "left")
            follows = F.col("merged").isNotNull() & end_tokens_fit(tokens(F.col("content")), tokens(F.col("merged"))) & matches(F.col("content"), F.col("merged"), F.col("shape"))
            label = F.when(follows, F.struct(F.col("merged").alias("template"), F.col("next").alias("entry"))).otherwise(F.struct("template", "entry"))
            labelled = keep(moved.select("content", "cid1", "first_line", "weight", label.alias("label"))).select("content", "cid1", "first_line", "weight", "label.*")
        labelled = labelled.unionByName(found)
        rest = known.join(merging.select("cid1", F.col("old").alias("template")), ["cid1", "template"], "left_anti") if known is not None else None
        added = final.select("cid1", F.col("merged").alias("template"), F.col("entry").alias("seq"))
        old = known.select("cid1", F.col("template").alias("old"), F.col("seq").alias("replaces")) if known is not None else merging.select("cid1", "old", F.lit(None).cast("long").alias("replaces")).limit(0)
        rounds.append(final.join(old, ["cid1", "old"], "left").select("cid1", "entry", F.col("merged").alias("template"), F.lit(seq).alias("round"), "replaces"))
        known = keep((rest.unionByName(added) if rest is not None else added).groupBy("cid1", "template").agg(F.min("seq").alias("seq")))
        pending = seen.where("found is null").drop("found")
        seq += 1
    spark = lines.sparkSession
    trace = spark.createDataFrame([], "iter int, cid1 int, sample array<string>, answer string, template string, queries int, seconds double")
    for step in steps:
        trace = trace.unionByName(step.select("iter", "cid1", "sample", "answer", "template", "queries", "seconds"))
    entries = spark.createDataFrame([], "cid1 int, entry long, template string, round int, replaces long")
    for added in rounds:
        entries = entries.unionByName(added)
    repeated = keep(labelled.where("weight > 1").select("content", "template", "entry"))  # the others are their only line
    named = labelled.where("weight = 1").select(F.col("first_line").alias("line_id"), "content", "template", "entry").unionByName(masked.join(repeated, "content").select("line_id", "content", "template", "entry"))
    return named, trace, keep(entries.join(buckets, "cid1"))


def merge_forest(entries: DataFrame) -> DataFrame:
    """(cid1, entry, template, round, parent, root, root_template) of (cid1, entry, template, round, replaces).

    Roots are found by pointer jumping: as many joins as the logarithm of the longest chain of merges.
    """
    parents = entries.where("replaces is not null").select("cid1", F.col("replaces").alias("entry"), F.col("entry").alias("parent"))
    linked = keep(entries.join(parents.groupBy("cid1", "entry").agg(F.min("parent").alias("parent")), ["cid1", "entry"], "left"))
    jumps, open_ones = linked.select("cid1", "entry", F.coalesce("parent", "entry").alias("root")), True
    while open_ones:
        further = jumps.select("cid1", F.col("entry").alias("root"), F.col("root").alias("next"))
        jumps = keep(jumps.join(further, ["cid1", "root"]).select("cid1", "entry", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        open_ones, jumps = jumps.where("moved").limit(1).count() > 0, jumps.drop("moved")
    names = entries.select("cid1", F.col("entry").alias("root"), F.col("template").alias("root_template"))
    return linked.join(jumps, ["cid1", "entry"]).join(names, ["cid1", "root"]).select("cid1", "entry", "template", "round", "parent", "root", "root_template")
