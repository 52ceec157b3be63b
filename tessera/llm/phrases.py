"""Operator 11: phrase collocations, mined by pivot partitioning.

1. Words are counted for each language. The most frequent ones, ``LISTED`` at most, go to all tasks as hashes with
   their counts: they order words by rarity. If the list holds every word that is frequent enough, all others are
   blanks: no frequent phrase holds them.
2. A phrase belongs to its rarest word, its pivot. For each place of a word, the fragment around it is rewritten to
   what can matter for this pivot: up to four more frequent words to the left, up to four words no rarer to the
   right, within the piece. So each occurrence of a phrase is in one fragment, that of its leftmost pivot. Equal
   fragments of a batch of documents travel once, with their number.
3. Fragments are routed by their core, at first the pivot, and the phrases that hold it are mined there. Common words have
   little data, as hardly a word is more common. A core of more than ``SPLIT_ROWS`` places is divided by the word beside
   it: a phrase grows from its pivot to its right end, then to its left, and belongs to the first core on this way that
   has no more places, or is the phrase itself. So all occurrences of a phrase are counted in one place, and rare ones
   go no further. Which runs of words have so many places is counted before.
4. Scores join the phrases' counts with those of their parts; phrases inside longer ones of the same count go; the
   best of each language are taken in two steps, so no task ranks a whole language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import FOLDED_VALUE, Runs, Words, arrow_batches, long_array, materialise, mix, pieces, table, text_slices

#: Words of a phrase, and occurrences that make it frequent.
MOST_WORDS, LEAST_COUNT = 5, 100
#: Words whose counts go to all tasks, at most: 16 bytes each.
LISTED = 1 << 20
#: Places beyond which a core, a pivot or a run of words around it, is divided.
SPLIT_ROWS = 1 << 16
#: Bytes of text whose fragments are found at once.
CHUNK_BYTES = 1 << 20
#: Fragments that a task holds to merge equal ones, some 100 bytes each, and buckets of cores for each partition of a shuffle.
HELD_ROWS, BUCKETS = 400_000, 16
#: Parts into which a language's phrases are dealt before the best are ranked.
RANK_PARTS = 64

#: Words `[^\x20\x09]+` of pieces between `[.,;:!?\x0A-\x0D]`.
INNER = np.ones(256, bool)
INNER[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = False
BREAK = np.zeros(256, np.int32)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Chunk:
    """Words of some texts, or of a part of a long one, of which those from ``begin`` to before ``end`` are its own."""

    data: np.ndarray
    words: Words
    row: np.ndarray  # of each word, in the batch
    begin: int
    end: int


def chunks(texts: pa.Array, around: int = 0, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Every word of a batch of texts is a chunk's own once; ``around`` words on either side of it are in its chunk."""
    for i, j, data, offsets in text_slices(texts, limit):
        if len(data) <= 2 * limit:
            words = Words(data, offsets, INNER, FOLDED_VALUE)
            yield Chunk(data, words, np.repeat(np.arange(i, j), np.diff(words.first)), 0, len(words.starts))
            continue
        start, begin = 0, 0  # of one text: where the chunk starts, and its first own word
        for a, b in pieces(data, INNER, limit):
            words = Words(data[start:b], np.array([0, b - start]), INNER, FOLDED_VALUE)
            n = len(words.starts)
            end = n if b == len(data) else max(begin, n - around)
            yield Chunk(data[start:b], words, np.full(n, i), begin, end)
            first = max(0, end - around)
            start, begin = (start + int(words.starts[first]), end - first) if first < n else (b, 0)


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[starts[k] : ends[k]]."""
    sizes = ends - starts
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def language_hashes(langs: pa.Array) -> np.ndarray:
    """A 64-bit hash for each row's language."""
    coded = langs.dictionary_encode()
    each = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, salt = batch.column(0), language_hashes(batch.column(0))
            for c in chunks(batch.column(1)):
                own = slice(c.begin, c.end)
                _, first, n = np.unique(c.words.hash[own] ^ mix(salt[c.row[own]]), return_index=True, return_counts=True)
                at = first + c.begin
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(c.row[at])), gathered(LOWER[c.data], c.words.starts[at], c.words.ends[at]), pa.array(n)], ["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of ``n`` of each."""
    each, where = np.unique(keys, return_inverse=True)
    out = np.zeros(len(each), np.int64)
    np.add.at(out, where, n)
    return each, out


def _keys(words: Words, salt: np.ndarray) -> np.ndarray:
    """One key for each word of a language."""
    return mix(words.hash ^ mix(salt))


@dataclass(frozen=True)
class Rarity:
    """Keys of the most frequent words, sorted, and their counts. ``complete``: no other word is frequent enough."""

    keys: np.ndarray
    counts: np.ndarray
    complete: bool

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of words by their keys; 0 for one that is not listed."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def rarity(words: DataFrame, least: int, listed: int = LISTED) -> Rarity:
    """Of (lang, word, n): ``listed`` words at most are collected, whatever the input."""
    frequent = words.where(F.col("n") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                found = Words(data, offsets, INNER, FOLDED_VALUE)  # one word each
                yield pa.RecordBatch.from_arrays([pa.array(_keys(found, language_hashes(batch.column(0).slice(i, j - i))).view(np.int64)), batch.column(2).slice(i, j - i)], ["key", "n"])

    top = frequent.mapInArrow(run, "key long, n long").orderBy(F.desc("n"), "key").limit(listed + 1).toArrow()
    keys, counts = (top[c].to_numpy() for c in ("key", "n"))
    keys, counts = keys[:listed].astype(np.int64).view(np.uint64), counts[:listed].astype(np.int64)
    order = np.argsort(keys)
    return Rarity(keys[order], counts[order], top.num_rows <= listed)


def _follows(c: Chunk) -> np.ndarray:
    """Whether each word stands in one piece with the word before it."""
    breaks = np.concatenate([[0], np.cumsum(BREAK[c.data], dtype=np.int32)])
    follows = np.zeros(len(c.words.starts), bool)
    follows[1:] = (breaks[c.words.starts[1:]] == breaks[c.words.ends[:-1]]) & (c.row[1:] == c.row[:-1])
    return follows


def divided_runs(rows: DataFrame, known, n_words: int, most: int = MOST_WORDS, split_rows: int = SPLIT_ROWS) -> np.ndarray:
    """Keys, sorted, of the runs of two words or more that are divided as cores, of (lang, text) of ``n_words`` words.

    A task counts the runs of words of more than ``split_rows`` places, as many at once as ``HELD_ROWS`` go, and leaves out those of
    so small a share that they miss ``split_rows / 2`` places in all at most. So all runs of more than ``split_rows`` places are
    found, and none of half as many. They are the ``LISTED`` most frequent, whatever the input; a run that is not listed stays whole.
    """
    share = split_rows / (2 * max(n_words, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, counts, words = known.value, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

        def merged() -> None:
            nonlocal keys, counts
            each, n = _totals(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [each], [n]

        def rows_out() -> pa.RecordBatch:
            nonlocal keys, counts, words
            merged()
            enough = counts[0] > share * words
            out = pa.RecordBatch.from_arrays([pa.array(long_array(keys[0][enough])), pa.array(counts[0][enough])], ["key", "n"])
            keys, counts, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
            return out

        for batch in batches:
            salt = language_hashes(batch.column(0))
            for c in chunks(batch.column(1), 2 * (most - 1)):
                words += c.end - c.begin
                found = _keys(c.words, salt[c.row])
                each, where = np.unique(found, return_inverse=True)
                hot, follows, runs = (seen.of(each) > split_rows)[where], _follows(c), Runs(found)
                at = np.flatnonzero(hot[c.begin : c.end]) + c.begin
                for m in range(1, most - 1):  # a run of m + 1 words
                    at = at[at + m < len(found)]
                    at = at[hot[at + m] & follows[at + m]]
                    each, n = np.unique(runs.of(at, at + m + 1), return_counts=True)
                    keys.append(each)
                    counts.append(n)
                if sum(map(len, keys)) > HELD_ROWS:
                    merged()
                    if len(keys[0]) > HELD_ROWS // 2:
                        yield rows_out()
        yield rows_out()

    total = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > split_rows // 2)
    return np.sort(total.orderBy(F.desc("n"), "key").limit(LISTED).toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64))


def _context(rank: np.ndarray, follows: np.ndarray, pivot: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pivot: words to its left that are all more frequent, and words to its right none of which is rarer."""
    n = len(rank)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    goes, comes = pivot.copy(), pivot.copy()
    for s in range(1, min(most, n)):
        goes[:s] = False
        goes[s:] &= follows[1 : n - s + 1] & (rank[:-s] < rank[s:])
        left += goes
        comes[n - s :] = False
        comes[:-s] &= follows[s:] & (rank[s:] <= rank[:-s])
        right += comes
    return left, right


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the distinct pairs of hashes."""
    _, at, where, n = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
    if (second[at][where] == second).all():
        return at, n
    order = np.lexsort((second, first))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)]))
    return order[new], np.diff(np.concatenate([new, [len(order)]]))


class Gathered:
    """Distinct fragments of a task so far: rows of equal hashes are one, with the sum of their numbers."""

    def __init__(self) -> None:
        self._numbers: list[tuple[np.ndarray, ...]] = []
        self._strings: list[tuple[pa.Array, ...]] = []
        self.rows = 0

    def add(self, numbers: tuple[np.ndarray, ...], strings: tuple[pa.Array, ...]) -> None:
        """``numbers``: two hashes, number, core, bucket; ``strings``: language, core, words left and right of it."""
        self._numbers.append(numbers)
        self._strings.append(strings)
        self.rows += len(numbers[0])

    def merge(self) -> None:
        if len(self._numbers) < 2:
            return
        first, second, n, *rest = (np.concatenate(x) for x in zip(*self._numbers, strict=True))
        order = np.lexsort((second, first))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)]))
        at = order[new]
        strings = tuple(pa.concat_arrays(x).take(pa.array(at)) for x in zip(*self._strings, strict=True))
        self._numbers, self._strings, self.rows = [(first[at], second[at], np.add.reduceat(n[order], new), *[x[at] for x in rest])], [strings], len(at)

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        """A row for each bucket and language, its fragments a line each: core, left, right and, if more than one, the number. Nothing is held afterwards."""
        self.merge()
        for (_, second, n, core, bucket), strings in zip(self._numbers, self._strings, strict=True):
            code = strings[0].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((second, core, code, bucket))
            lang, word, left, right = (x.take(pa.array(order)) for x in strings)
            times = pc.if_else(pa.array(n[order] == 1), pa.scalar(None, pa.string()), pa.array(n[order]).cast(pa.string()))
            lines = pc.binary_join_element_wise(word, left, right, times, "\t", null_handling="skip")
            new = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(code[order]) != 0)]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(order)]]).astype(np.int32)), lines), "\n")
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][new]), lang.take(pa.array(new)), joined], ["bucket", "lang", "fragments"])
        self._numbers, self._strings, self.rows = [], [], 0


def _cores(lo: np.ndarray, at: np.ndarray, hi: np.ndarray, divided: np.ndarray, many: np.ndarray, runs: Runs, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(lo, begin, end, hi): fragments from lo to hi with cores from begin to end, of all words from lo to hi around pivots.

    Phrases of a fragment hold its core. ``divided`` says which pivots have too many places, ``many`` are the keys of such runs.
    One that has them gives the core alone, a fragment around the core and the word to its right, and one around the
    core and the word to its left, which ends where the core does: each phrase is in one of them.
    """
    begin, end = at, at + 1
    while len(begin):
        kept = ~divided
        yield tuple(x[kept] for x in (lo, begin, end, hi))
        lo, begin, end, hi = (x[divided] for x in (lo, begin, end, hi))
        alone = end - begin > 1
        yield begin[alone], begin[alone], end[alone], end[alone]
        left, right = lo < begin, end < hi
        lo, begin, end, hi = (np.concatenate(x) for x in ((lo[right], lo[left]), (begin[right], begin[left] - 1), (end[right] + 1, end[left]), (hi[right], end[left])))
        lo, hi = np.maximum(lo, end - most), np.minimum(hi, begin + most)
        divided = (end - begin < most) & np.isin(runs.of(begin, end), many)


def _fragments_of(c: Chunk, langs: pa.Array, salt: np.ndarray, seen: Rarity, many: np.ndarray, most: int, split_rows: int, buckets: int) -> tuple | None:
    """Distinct fragments of a chunk, as `Gathered.add` takes them."""
    n = len(c.words.starts)
    if n < 2:
        return None
    keys = _keys(c.words, salt[c.row])
    each, where = np.unique(keys, return_inverse=True)
    counts = seen.of(each)
    rank = np.empty(len(each), np.int32)
    rank[np.lexsort((each, -counts))] = np.arange(len(each))  # the order that all tasks share, here by numbers
    pivot = (counts > 0)[where] if seen.complete else np.ones(n, bool)
    pivot[: c.begin] = pivot[c.end :] = False
    left, right = _context(rank[where], _follows(c), pivot, most)
    at = np.flatnonzero(left + right)
    if not len(at):
        return None
    runs = Runs(keys)
    lo, begin, end, hi = (np.concatenate(x) for x in zip(*_cores(at - left[at], at, at + right[at] + 1, (counts > split_rows)[where[at]], many, runs, most), strict=True))
    shape = (most + 1) * (begin - lo) + end - begin
    one, two = runs.of(lo, hi) ^ mix(shape.astype(np.uint64)), Runs(mix(keys ^ np.uint64(0x5851F42D4C957F2D))).of(lo, hi) ^ mix(~shape.astype(np.uint64))
    first, times = _distinct(one, two)
    one, two, lo, begin, end, hi = (x[first] for x in (one, two, lo, begin, end, hi))
    sizes = c.words.ends - c.words.starts
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # words joined by single spaces
    joined = np.full(begins[-1], 0x20, np.uint8)
    byte = np.arange(sizes.sum())
    joined[byte + np.repeat(np.arange(n), sizes)] = LOWER[c.data[byte + np.repeat(c.words.starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)]]
    own = runs.of(begin, end)
    bucket = (mix(own) % np.uint64(buckets)).astype(np.int32)
    texts = (gathered(joined, begins[i], np.maximum(begins[j] - 1, begins[i])) for i, j in ((begin, end), (lo, begin), (end, hi)))
    return (one, two, times, own, bucket), (langs.take(pa.array(c.row[begin])), *texts)


def fragments(rows: DataFrame, known, many: np.ndarray, most: int = MOST_WORDS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(bucket, lang, fragments) of (lang, text): what is mined together.

    A bucket holds all fragments of its cores; there are ``BUCKETS`` for each partition of a shuffle. Fragments are lines of the
    core, the words to its left and to its right, and their number. A task merges its equal fragments as far as
    ``HELD_ROWS`` go. ``known`` is a broadcast `Rarity`, ``many`` are the keys of `divided_runs`.
    """
    buckets = BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = rows.sparkSession.sparkContext.broadcast(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = known.value, Gathered()
        for batch in batches:
            langs, salt = batch.column(0), language_hashes(batch.column(0))
            for c in chunks(batch.column(1), 2 * (most - 1)):
                if found := _fragments_of(c, langs, salt, seen, shared.value, most, split_rows, buckets):
                    held.add(*found)
                if held.rows > HELD_ROWS:
                    held.merge()
                    if held.rows > HELD_ROWS // 2:
                        yield from held.rows_out()
        yield from held.rows_out()

    return rows.mapInArrow(run, "bucket int, lang string, fragments string")


def _phrases_of(lines: Counter, most: int) -> Counter:
    """Occurrences of the phrases that hold the core, from fragments and their numbers."""
    found: Counter = Counter()
    for line, times in lines.items():
        core, left, right, *number = line.split("\t")
        n = times * int(number[0]) if number else times
        size = core.count(" ") + 1
        head, heads, tail, tails = "", [""], "", [""]
        if left:
            for word in reversed(left.split(" ")):
                head = f"{word} {head}"
                heads.append(head)
        if right:
            for word in right.split(" "):
                tail = f"{tail} {word}"
                tails.append(tail)
        for i, head in enumerate(heads):
            begun = head + core
            for tail in tails[i == 0 and size == 1 : most - size - i + 1]:
                found[begun + tail] += n
    return found


def mined(found: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, phrase, n) of the phrases of two to ``most`` words that occur ``least`` times, from `fragments`.

    Buckets are mined one after the other. All occurrences of a phrase are in one bucket, so only frequent ones go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(key: tuple, lines: Counter) -> pa.RecordBatch:
            kept = {p: n for p, n in _phrases_of(lines, most).items() if n >= least}
            return pa.RecordBatch.from_arrays([pa.array([key[1]] * len(kept), pa.string()), pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["lang", "phrase", "n"])

        held, lines = None, Counter()
        for batch in batches:
            for *key, fragments in zip(*[batch.column(c).to_pylist() for c in ("bucket", "lang", "fragments")], strict=True):
                if tuple(key) != held and held:
                    yield settled(held, lines)
                    lines = Counter()
                held = tuple(key)
                lines.update(fragments.split("\n"))
        if held:
            yield settled(held, lines)

    return found.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(run, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, lang_col: str = "lang", text_col: str = "text", listed: int = LISTED, split_rows: int = SPLIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """((lang, word, n) of all words, (lang, phrase, n) of the frequent phrases of two to ``most`` words)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = materialise(word_counts(rows))
    rare = rarity(words, least, listed)
    known, many = spark.sparkContext.broadcast(rare), np.zeros(0, np.uint64)
    if (rare.counts > split_rows).any():
        many = divided_runs(rows, known, words.agg(F.sum("n")).first()[0], most, split_rows)
    return words, materialise(mined(fragments(rows, known, many, most, split_rows), most, least))


def scored(chosen: DataFrame, words: DataFrame, phrases: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the chosen phrases, at the lowest-scoring cut, the first of equal ones.

    Products are decimals of 38 digits: exact for corpora of up to 10^15 words.
    """
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = phrases.select("lang", F.col("phrase").alias("part"), "n").unionByName(words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), "n"))
    cuts = chosen.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    for side, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(side), F.col("n").alias(count)), ["lang", side])
    exact = F.expr("(cast(1000 * a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.join(totals, "lang").withColumn("score", exact).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def maximal(phrases: DataFrame) -> DataFrame:
    """The phrases of (lang, phrase, n) without those that stand, as often, inside a longer one."""
    w = F.col("w")

    def inside(length: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.array_join(F.slice(w, i, length), " "))

    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), inside))
    within = phrases.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 2).select("lang", "n", F.explode(shorter).alias("phrase"))
    most = within.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    return phrases.join(most, ["lang", "phrase"], "left").where("longest is null or longest < n").drop("longest")


def collocations(docs: DataFrame, top: int = 2000, most: int = MOST_WORDS, least: int = LEAST_COUNT, lang_col: str = "lang", text_col: str = "text", listed: int = LISTED, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The phrases of each language whose words stand together most, against chance.

    Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, pieces at spaces and tabs into
    words. Returns lang, rank (from 1), phrase, a (its occurrences), l and r (those of the two parts of its
    lowest-scoring cut), n (words of the language) and score, floor(1000 a n / (l r)); ``top`` rows of each
    language at most, by score, a and phrase. A phrase has two to ``most`` words and occurs ``least`` times or more;
    one that always stands inside the same longer one is left out. A null language is `und`, a null or empty text
    has no words; repeated rows count as often as they occur; a text of any length is worked on in chunks; an
    empty table gives an empty result; other columns are ignored.
    """
    words, phrases = phrase_counts(docs, most, least, lang_col, text_col, listed, split_rows)
    ranked = scored(materialise(maximal(phrases)), words, phrases, least)
    order = (F.desc("score"), F.desc("a"), "phrase")
    few = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
