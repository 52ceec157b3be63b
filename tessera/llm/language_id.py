"""Operator 6: language identification of whole, possibly mixed texts.

A word's script narrows its candidate languages, byte trigrams give it a score for each, and a Viterbi
path over the words with a penalty for every switch labels the spans of a text. How much likelier the path
makes the text's letters than chance, all trigrams alike, is the evidence that it is language at all.

Texts of more than a slice are worked on in pieces that end where a word ends. The best path is exact all the
same: values are kept at the pieces' bounds on the way forward, and each piece is worked out again on the
way back, so memory is that of one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Words, arrow_batches, pieces, table, text_slices

BUCKET_BITS = 16
#: Documents of each language, about, from which a model learns; they are chosen by a hash of their ids.
TRAIN_PER_LANGUAGE = 2000
#: Languages of a model at most, unless told otherwise: 256 KB of scores each go to every task.
MOST_LANGUAGES = 500
#: Log-likelihood that a switch of languages must gain.
SWITCH_PENALTY = 24.0
#: Share of a language's letters below which a script is not one of its own.
SCRIPT_SHARE = 0.005
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: First code points of script ranges; a range ends where the next begins. Fixed values of Unicode.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0E00, 0x1100, 0x1E00, 0x1F00, 0x3040, 0x3130, 0x3400, 0xAC00, 0xE000)
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Indic", "Thai", "Hangul", "Latin", "Greek", "Kana", "Hangul", "Han", "Hangul", "other")
NAMES = tuple(dict.fromkeys(SCRIPTS))
_SCRIPT_OF_RANGE = np.array([NAMES.index(x) for x in SCRIPTS])


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals of Latin-1 in lower case."""
    out = data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    if len(data) > 1:
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[upper] += 0x20
    return out


class Features:
    """Words of a run of texts, the trigram bucket of each of their bytes, and each word's script."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets, LETTERS, hashed=False)
        low = folded(data).astype(np.uint32)
        starts, ends = self.words.starts, self.words.ends
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        before, after = np.concatenate([[np.uint32(0x20)], low[:-1]]), np.concatenate([low[1:], [np.uint32(0x20)]])
        before[starts] = 0x20
        after[ends - 1] = 0x20
        keys = (before[at] << np.uint32(16) | low[at] << np.uint32(8) | after[at]) * np.uint32(0x9E3779B1)
        self.buckets = (keys >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        self.sizes = ends - starts
        self.script = self._scripts(data)

    def _scripts(self, data: np.ndarray) -> np.ndarray:
        """The script of each word, told by the word's first character beyond ASCII that isn't Latin, if any."""
        script = np.zeros(len(self.words.starts), np.int64)
        lead = np.flatnonzero(data >= 0xCD)  # U+0340 and beyond
        if len(lead):
            more = [np.concatenate([data[k:], np.zeros(k, np.uint8)])[lead].astype(np.int64) & 0x3F for k in (1, 2, 3)]
            first = data[lead].astype(np.int64)
            point = np.where(first < 0xE0, (first & 0x1F) << 6 | more[0], np.where(first < 0xF0, (first & 0x0F) << 12 | more[0] << 6 | more[1], (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
            kind = _SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, point, "right") - 1]
            word = np.searchsorted(self.words.starts, lead, "right") - 1
            np.maximum.at(script, word, kind)
        return script


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # [bucket, language] log-probabilities
    allowed: np.ndarray  # [script, language] whether the language has the script

    def words(self, features: Features) -> np.ndarray:
        """[word, language] scores; a language without the word's script is out, unless all are."""
        if not len(features.sizes):
            return np.zeros((0, len(self.languages)))
        edges = np.concatenate([[0], np.cumsum(features.sizes)[:-1]])
        found = np.add.reduceat(self.scores[features.buckets], edges, axis=0).astype(np.float64)
        kinds = np.unique(features.script)
        if not self.allowed[kinds].all():
            allowed = np.where(self.allowed.any(1, keepdims=True), self.allowed, True)[features.script]
            found = np.where(allowed, found, found.min(1, keepdims=True) - SWITCH_PENALTY)
        return found


def viterbi(scores: np.ndarray, penalty: float, start: np.ndarray | None = None, end: int | None = None) -> tuple[np.ndarray, int, np.ndarray]:
    """The best path of languages over words, the language before them, and the values after them.

    ``start`` are the values of the words before, ``end`` is the last word's language; by default there are
    none before, and the path ends where it is best.
    """
    n, k = scores.shape
    own, back = np.arange(k), np.zeros((n, k), np.int16)
    value = np.zeros(k) if start is None else start
    for t in range(n):
        best = int(value.argmax())
        jump = value[best] - (penalty if t or start is not None else 0.0)
        back[t] = np.where(value >= jump, own, best)
        value = np.maximum(value, jump) + scores[t]
    path = np.empty(n, np.int16)
    path[-1] = value.argmax() if end is None else end
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, int(back[0, path[0]]), value


def best_paths(scores: np.ndarray, first: np.ndarray, texts: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of each of several texts, all a word at a time; words of other texts have language 0."""
    n, k = scores.shape
    path, back = np.zeros(n, np.int16), np.zeros((n, k), np.int16)
    sizes = first[texts + 1] - first[texts]
    order = np.argsort(-sizes, kind="stable")
    begin, sizes, own = first[texts][order], sizes[order], np.arange(k)
    value = scores[begin].copy()
    longer = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # texts of more than t words
    for t in range(1, len(longer)):
        m = longer[t]
        now, at = value[:m], begin[:m] + t
        best = now.argmax(1)
        jump = (now[np.arange(m), best] - penalty)[:, None]
        back[at] = np.where(now >= jump, own, best[:, None])
        value[:m] = np.maximum(now, jump) + scores[at]
    state = value.argmax(1).astype(np.int16)
    for t in range(len(longer) - 1, -1, -1):
        m = longer[t]
        at = begin[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return path


def constant_paths(scores: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its best single language, the margin to the second, and whether that is the Viterbi path.

    It is if no run of words gains over half a penalty by another language: an excursion of r runs pays r
    penalties at least, and a path without the best language r - 1, while the runs gain r halves at most.
    """
    n_texts, (n, k) = len(first) - 1, scores.shape
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(scores, axis=0)])
    total = sums[first[1:]] - sums[first[:-1]]
    best = total.argmax(1)
    order = np.sort(total, axis=1)
    margin = order[:, -1] - order[:, -2] if k > 1 else np.full(n_texts, np.inf)
    text = np.repeat(np.arange(n_texts), np.diff(first))
    gain = np.cumsum(scores - scores[np.arange(n), best[text]][:, None], axis=0)
    before = np.concatenate([np.zeros((1, k)), gain[:-1]])
    step = 2 * (np.abs(gain).max(initial=0) + 1)
    low = np.minimum.accumulate(before - step * text[:, None], axis=0) + step * text[:, None]
    most = np.zeros(n_texts)
    np.maximum.at(most, text, (gain - low).max(1))
    return best, margin, most <= penalty / 2


@dataclass
class Labelled:
    """A text's spans (start, end, number of the language), letters of each language, margin, and evidence per letter."""

    spans: list[tuple[int, int, int]]
    letters: np.ndarray
    margin: float
    evidence: float


def _spans(path: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
    return [(int(starts[a]), int(ends[b - 1]), int(path[a])) for a, b in zip(edges, edges[1:], strict=False)]


def _long(model: Model, data: np.ndarray, penalty: float, limit: int) -> Labelled | None:
    """A text of more than ``limit`` bytes; a run of letters that long counts as several words."""
    k, cuts = len(model.languages), list(pieces(data, LETTERS, limit, hard=True))
    before, value, total = [], None, np.zeros(k)
    for a, b in cuts:
        before.append(value)
        scores = model.words(Features(data[a:b], np.array([0, b - a])))
        if len(scores):
            value, total = viterbi(scores, penalty, value)[2], total + scores.sum(0)
    if value is None:
        return None
    end, spans, letters, gain = int(value.argmax()), [], np.zeros(k, np.int64), 0.0
    for (a, b), start in zip(reversed(cuts), reversed(before), strict=True):
        features = Features(data[a:b], np.array([0, b - a]))
        scores = model.words(features)
        if len(scores):
            path, end, _ = viterbi(scores, penalty, start, end)
            own = _spans(path, features.words.starts + a, features.words.ends + a)
            if spans and own[-1][2] == spans[0][2]:
                spans[0] = (own[-1][0], *spans[0][1:])
                own.pop()
            spans = own + spans
            letters += np.bincount(path, features.sizes, k).astype(np.int64)
            gain += float(scores[np.arange(len(path)), path].sum())
    total.sort()
    return Labelled(spans, letters, float(total[-1] - total[-2]) if k > 1 else np.inf, gain / letters.sum() + BUCKET_BITS * np.log(2))


def label(model: Model, texts: pa.Array, penalty: float, limit: int | None = None) -> Iterator[tuple[int, Labelled]]:
    """(row, result) of each text with words, in order; ``limit`` bytes of text are worked on at a time."""
    k = len(model.languages)
    limit = limit or max(1 << 16, (1 << 20) * 8 // max(8, k))
    for i, j, data, offsets in text_slices(texts, limit):
        if len(data) > limit:
            if found := _long(model, data, penalty, limit):
                yield i, found
            continue
        features = Features(data, offsets)
        first, scores = features.words.first, model.words(features)
        best, margin, constant = constant_paths(scores, first, penalty)
        starts, ends, some = features.words.starts, features.words.ends, np.flatnonzero(np.diff(first))
        paths = best_paths(scores, first, some[~constant[some]], penalty)
        if len(some):
            text = np.repeat(np.arange(j - i), np.diff(first))
            paths = np.where(constant[text], best[text], paths)
            gains = np.add.reduceat(scores[np.arange(len(paths)), paths], first[some])
            totals = np.add.reduceat(features.sizes, first[some])
        for n, gain, total in zip(some, gains.tolist() if len(some) else [], totals.tolist() if len(some) else [], strict=True):
            a, b, off = first[n], first[n + 1], offsets[n]
            if constant[n]:
                letters = np.zeros(k, np.int64)
                letters[best[n]] = total
                spans = [(int(starts[a] - off), int(ends[b - 1] - off), int(best[n]))]
            else:
                letters, spans = np.bincount(paths[a:b], features.sizes[a:b], k).astype(np.int64), _spans(paths[a:b], starts[a:b] - off, ends[a:b] - off)
            yield i + int(n), Labelled(spans, letters, float(margin[n]), gain / total + BUCKET_BITS * np.log(2))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = TRAIN_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """Fit trigram scores on the rows with a label, about ``per_language`` of each; None if there are none.

    The counts that come to the driver are at most 2**16 for each language. More than ``most_languages``
    different labels are an error: raise it where tasks have the memory, 256 KB for each language.
    """
    arrow_batches(docs.sparkSession)
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    found = sorted((r[0], r.n) for r in labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect())
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} labels")
    if not found:
        return None
    names = tuple(x for x, _ in found)
    share = docs.sparkSession.createDataFrame([(x, k, min(1.0, per_language / n)) for k, (x, n) in enumerate(found)], "lang string, number int, share double")
    uniform = F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.select(F.col(label_col).alias("lang"), F.col(text_col).cast("string").alias("text"), uniform.alias("uniform")).join(F.broadcast(share), "lang").where("uniform < share").select("number", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), (1 << BUCKET_BITS) + len(NAMES)), np.int64)
        for batch in batches:
            number = batch.column(0).to_numpy()
            for i, j, data, offsets in text_slices(batch.column(1)):
                features = Features(data, offsets)
                own = number[i:j][np.repeat(np.arange(j - i), np.diff(features.words.first))]
                for k in np.unique(own):
                    mine = own == k
                    counts[k, : 1 << BUCKET_BITS] += np.bincount(features.buckets[np.repeat(mine, features.sizes)], minlength=1 << BUCKET_BITS)
                    counts[k, 1 << BUCKET_BITS :] += np.bincount(features.script[mine], features.sizes[mine], len(NAMES)).astype(np.int64)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[k, b])], ["number", "bucket", "n"])

    counts = np.zeros((len(names), (1 << BUCKET_BITS) + len(NAMES)))
    rows = chosen.mapInArrow(run, "number int, bucket int, n long").groupBy("number", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[rows["number"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    trigrams, scripts = counts[:, : 1 << BUCKET_BITS] + 0.1, counts[:, 1 << BUCKET_BITS :]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(names, np.log(trigrams / trigrams.sum(1, keepdims=True)).T.astype(np.float32).copy(), allowed.T.copy())


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(id, lang_pred, score, evidence, spans) of every row.

    ``spans`` are (start, end, lang) in bytes of the UTF-8 text, in order. lang_pred labels most of the
    letters; score is its share of them times the certainty 1 - exp(-margin) over the second language.
    evidence is the log-likelihood of the labelled text per letter byte, less that of trigrams that are all
    alike: not above 0 where no language explains the text better than chance. A null text, one without
    letters, and every text without a model are `und` with score 0, no evidence and no spans. Repeated rows
    give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: tuple[list, list, list, list] = (["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [[]] * len(texts))
            for row, found in label(model, batch.column(1), penalty) if model else ():
                if _has_letter(texts[row]):
                    best = int(found.letters.argmax())
                    out[0][row] = model.languages[best]
                    out[1][row] = float(found.letters[best] / found.letters.sum() * -np.expm1(-max(0.0, found.margin)))
                    out[2][row] = found.evidence
                    out[3][row] = [{"start": a, "end": b, "lang": model.languages[k]} for a, b, k in found.spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], span)], ["id", "lang_pred", "score", "evidence", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, evidence double, spans array<struct<start: long, end: long, lang: string>>").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", penalty: float = SWITCH_PENALTY, least: float = 0.0) -> DataFrame:
    """``docs``, all columns, without the rows that are in no language of the model.

    These are `und` of ``identify``, and texts whose evidence is not above ``least``: no path of languages
    makes them likelier than chance. Without a model the texts with a letter stay. Rows stay where they
    are: no shuffle.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # columns may have any name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            keep = np.array([_has_letter(x) for x in texts.to_pylist()], bool)
            if model:
                spoken = np.zeros(len(keep), bool)
                for row, found in label(model, texts, penalty):
                    spoken[row] = found.evidence > least
                keep &= spoken
            yield batch.filter(pa.array(keep))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "evidence")
