"""Operator 8: URL filter by rules and, where none fits, by character language models.

Two variable-order Markov models, of accepted and of rejected URLs, give a URL's log-likelihoods. Their
difference per character is compared with a threshold that is calibrated on labelled URLs that the
models have not seen. The models are smoothed by escape (Witten-Bell): after a context of k characters
the mass of new characters goes to the context of k - 1, and at last to a uniform distribution over bytes.
Below their longest contexts both fall back to one model of all labelled URLs, of all orders, so what
neither has seen speaks for neither, though one of them has learned from many more URLs.

Counts are exact: the longest context with its byte is six bytes, a number of its own, and a model has an
entry for each that occurs. So a model grows with the number of distinct strings of six bytes in the labelled
URLs. Up to ``MOST_GRAMS`` of these it is gathered on the driver and sent to the tasks; a larger one stays a
table, and the strings of the URLs to be scored join it order by order. Both give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import arrow_batches, materialise, table

#: Rules (verdict, host, path). A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Longest context in bytes; with its byte it fits in a long.
ORDER = 5
#: Shortest context at which the models of accepted and rejected URLs differ from the common one.
OWN_ORDER = 4
#: Distinct strings of six bytes up to which a model is sent to all tasks, in some 400 bytes for each.
MOST_GRAMS = 1_000_000
#: Share of the labelled URLs that calibrate the threshold, and the steps in which it is searched.
CALIBRATION_SHARE, STEPS = 0.2, 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z in lower case, and the path; both empty for null or no `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_and_verdict(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written host and path, and its verdict; null where none fits.

    Longest is the most characters of host and path together; of equally long rules the last by name.
    """
    kind = "struct<n: int, rule: string, verdict: string>"
    fitting = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")).cast(kind)) for v, h, p in rules]
    best = F.greatest(*fitting, *[F.lit(None).cast(kind)] * 2)
    return best["rule"], best["verdict"]


def grams(text: bytes) -> np.ndarray:
    """For every byte, it and the ORDER bytes before it as one number, the byte lowest; an end byte is added."""
    data = np.frombuffer(b"\x02" * ORDER + text + b"\x03", np.uint8).astype(np.int64)
    out = np.zeros(len(text) + 1, np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | data[k : k + len(out)]
    return out


def orders(found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the context and the context with the byte, as numbers."""
    for k in range(ORDER + 1):
        full = found & ((1 << 8 * (k + 1)) - 1)
        yield full >> 8, full


def contexts(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, every byte's context and the context with the byte, as numbers; an end byte is added."""
    return orders(grams(text))


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of ``n`` of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _found(keys: np.ndarray, values: tuple[np.ndarray, ...], wanted: np.ndarray) -> list[np.ndarray]:
    """The values of the wanted keys, 0 where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return [np.where(keys[at] == wanted, v[at], 0) for v in values]


@dataclass(frozen=True)
class Markov:
    """For each order, sorted contexts with a byte and their counts, and sorted contexts, their counts and their different bytes."""

    full: list[tuple[np.ndarray, np.ndarray]]
    context: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, found: np.ndarray, n: np.ndarray) -> Markov:
        """From the counts of `grams`."""
        full = [_totals(keys, n) for _, keys in orders(found)]
        return cls(full, [(*_totals(keys >> 8, count), _totals(keys >> 8, np.ones_like(count))[1]) for keys, count in full])

    def probabilities(self, slots: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray | float, shortest: int = 0) -> np.ndarray:
        """Of every byte, from the contexts of ``shortest`` bytes on, with ``p`` below these."""
        for k in range(shortest, ORDER + 1):
            context, full = slots[k]
            keys, *values = self.context[k]
            n, kinds = _found(keys, tuple(values), context)
            (times,) = _found(self.full[k][0], (self.full[k][1],), full)
            p = np.where(n > 0, (times + kinds * p) / np.maximum(n + kinds, 1), p)
        return p


@dataclass(frozen=True)
class UrlModel:
    allow: Markov
    block: Markov
    common: Markov
    threshold: float = 0.0

    def ratios(self, found: np.ndarray) -> np.ndarray:
        """Logarithms of how much likelier the last byte of each of `grams` is in accepted URLs."""
        slots = list(orders(found))
        below = self.common.probabilities(slots, 1 / 256)
        return np.log(self.allow.probabilities(slots, below, OWN_ORDER) / self.block.probabilities(slots, below, OWN_ORDER))

    def score(self, url: str) -> float:
        """Difference of the log-likelihoods per character, accepted less rejected."""
        return self.scores([url])[0]

    def scores(self, urls: list[str]) -> list[float]:
        """The scores of several URLs; what they have in common is looked up once."""
        own = [grams(url.encode()) for url in urls]
        if not own:
            return []
        distinct, where = np.unique(np.concatenate(own), return_inverse=True)
        parts = np.split(self.ratios(distinct)[where], np.cumsum([len(x) for x in own])[:-1])
        return [float(x.mean()) for x in parts]


@dataclass(frozen=True)
class TableModel:
    """Counts (gram, allow, block) of a model that is not gathered."""

    counts: DataFrame
    threshold: float = 0.0


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, allow, block) of (url, verdict): how often each string of six bytes occurs, exact, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, urls = np.array(batch.column(1).to_pylist(), object), batch.column(0).to_pylist()
            for verdict in set(verdicts):
                found, n = np.unique(np.concatenate([grams(u.encode()) for u, v in zip(urls, verdicts, strict=True) if v == verdict]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n * (verdict == "allow")), pa.array(n * (verdict == "block"))], ["gram", "allow", "block"])

    return materialise(labelled.mapInArrow(run, "gram long, allow long, block long").groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))


def fitted(labelled: DataFrame, most_grams: int) -> UrlModel | TableModel | None:
    """A model of (url, verdict), None if a verdict has no URL."""
    counts = gram_counts(labelled)
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block")).first()
    if not size.allow or not size.block:
        return None
    if size.n > most_grams:
        return TableModel(counts)
    rows = counts.toArrow()  # at most most_grams rows
    found, allow, block = (rows[c].to_numpy() for c in ("gram", "allow", "block"))
    return UrlModel(*[Markov.of(found[n > 0], n[n > 0]) for n in (allow, block, allow + block)])


def _table_ratios(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio) of (gram): `UrlModel.ratios` by a join with each order's counts and contexts."""
    kinds = {"allow": F.col("allow"), "block": F.col("block"), "all": F.col("allow") + F.col("block")}
    rows, p = wanted, F.lit(1 / 256)
    for k in range(ORDER + 1):
        full = counts.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("full")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = full.groupBy(F.shiftright("full", 8).alias("context")).agg(*[x for v, n in kinds.items() for x in (F.sum(n).alias(f"n_{v}"), F.count_if(n > 0).alias(f"kinds_{v}"))])
        seen = full.select("full", *[n.alias(f"times_{v}") for v, n in kinds.items()])
        rows = rows.withColumn("full", F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1)).withColumn("context", F.shiftright("full", 8)).join(seen, "full", "left").join(context, "context", "left")
        values = [F.coalesce(f"{x}_{v}", F.lit(0)).alias(f"{x}_{v}_{k}") for x in ("times", "n", "kinds") for v in (kinds if k >= OWN_ORDER else ("all",))]
        rows = rows.select("gram", *[c for c in rows.columns if c[-1].isdigit()], *values)

    def step(p: Column, v: str, k: int) -> Column:
        n, m = F.col(f"n_{v}_{k}"), F.col(f"kinds_{v}_{k}")
        return F.when(n > 0, (F.col(f"times_{v}_{k}") + m * p) / (n + m)).otherwise(p)

    for k in range(ORDER + 1):
        p = step(p, "all", k)
    rows = rows.withColumn("p", p)
    own = [F.col("p"), F.col("p")]
    for k in range(OWN_ORDER, ORDER + 1):
        own = [step(x, v, k) for x, v in zip(own, ("allow", "block"), strict=True)]
    return rows.select("gram", F.log(own[0] / own[1]).alias("ratio"))


def _scored_by_joins(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``urls`` with ``score``, of the column url; hot strings are counted once for each URL, and joined with one row each."""
    rows = materialise(urls.withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, n = np.unique(grams((url or "").encode()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(found), pa.array(n)], ["row", "gram", "n"])

    parts = rows.select("row", "url").mapInArrow(run, "row long, gram long, n long")
    ratios = materialise(_table_ratios(materialise(parts.select("gram").distinct()), counts))
    scores = parts.join(ratios, "gram").groupBy("row").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))
    return rows.join(scores, "row").drop("row")


def _scored(urls: DataFrame, model: UrlModel | TableModel) -> DataFrame:
    """``urls`` with ``score``, of the column url."""
    if isinstance(model, TableModel):
        return _scored_by_joins(urls, model.counts)
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([x or "" for x in batch.column("url").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return urls.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in urls.dtypes) + ", score double")


def learn(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", most_grams: int = MOST_GRAMS) -> UrlModel | TableModel | None:
    """Fit both models on rows with the verdicts allow and block, and calibrate the threshold.

    A fifth of the URLs, chosen by a hash, calibrates: the threshold has the best mean of the shares of
    either verdict that are judged right, the one nearest to 0 if several have; it is 0 where a verdict has
    no URL to calibrate with. Returns None if a verdict has no URL to learn from.
    """
    arrow_batches(labelled.sparkSession)
    rows = labelled.select(F.col(url_col).alias("url"), F.col(verdict_col).alias("verdict")).where(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block"))
    held = F.pmod(F.xxhash64("url"), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)
    model = fitted(rows.where(~held), most_grams)
    if model is None:
        return None
    bins = _scored(rows.where(held), model).withColumn("bin", F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") / STEPS)))).groupBy("verdict", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    good, bad = ({r.bin: r.n for r in bins if r.verdict == v} for v in ("allow", "block"))
    if not good or not bad:
        return model
    share = {t: sum(n for b, n in good.items() if b >= t) / sum(good.values()) + sum(n for b, n in bad.items() if b < t) / sum(bad.values()) for t in range(-1000, 1002)}
    best = max(share.values())
    return replace(model, threshold=STEPS * min((t for t, s in share.items() if s == best), key=abs))


def url_filter(pages: DataFrame, model: UrlModel | TableModel | None, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: (id, host, path, rule, verdict, score).

    Where no rule fits, the verdict is allow if the model's score reaches its threshold, else block; without
    a model it is allow. A null URL counts as empty, with empty host and path. Repeated rows give repeated
    results; other columns are ignored; no shuffle, but for a model that is a table.
    """
    arrow_batches(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    scored = _scored(rows, model) if model else rows.withColumn("score", F.lit(0.0))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= (model.threshold if model else 0.0), "allow").otherwise("block")
    return scored.withColumn("host", host).withColumn("path", path).select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str, most_grams: int = MOST_GRAMS) -> DataFrame:
    """The URLs that a rule judges are what the models learn from."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    labelled = pages.select("url", host.alias("host"), path.alias("path"))
    labelled = labelled.select("url", rule_and_verdict(F.col("host"), F.col("path"))[1].alias("verdict"))
    return url_filter(pages, learn(labelled, most_grams=most_grams))
