"""Operator 5: removal of repeated passages by a compacted de Bruijn graph of word windows.

A window of ``width`` consecutive words is an edge of the graph, from the node of its first ``width - 1``
words to that of its last. Consecutive windows that share their minimiser (the k-mer of the smallest hash in
the window, leftmost on ties) are one edge, a block: (anchor, content). The minimiser depends on the
window's words alone, so equal windows always meet under one anchor.

1. Edges. Blocks are dealt by their anchor, and those that occur again go on as edges. An anchor of several
   contents, at the ends of repeats, has the first block of each content opened: the windows of these are
   edges of a second kind, dealt by their hashes. A window starts earlier if its block is not the first of
   its content, or if it is not the first among the opened ones.
2. Compaction. Each edge looks at the one before it in its document; edges are counted, and so are pairs of
   neighbours, and joins of these counts find where one edge follows the other at every occurrence of
   either (out-degree and in-degree one): both are of one path. A path's occurrences are long repeated
   spans, named by the path's first edge.
3. Verification. Spans join their documents, and the words that stand at their source coordinates give a
   128-bit digest (BLAKE2b). Spans of one path and one digest are repeats; the first by id and start stays.
   Where a path's digests differ, its edges are verified one by one.
4. Documents join the spans that go, compare the words with the digest once more, and lose them.

Texts are dealt by id once, into a bucketed table that all joins by id read where it lies. Blocks travel in
binary arrays, a row for each batch of documents and bucket. A batch sends each content and each window
once and passes its own repeats through, so a passage that many documents share sends a row for each
batch, not for each document. An anchor of more than ``HOT`` contents in a batch sends two, which tell its
bucket that it branches; the others are opened at once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import run_dir
from .kernels import Runs, Words, arrow_batches, materialise, mix, table, text_slices, windows

WIDTH, KMER = 20, 10
#: Blocks of different content that a batch of documents sends under one anchor; if it has more, it sends two.
HOT = 16
#: Bytes of text whose entries meet in one bucket, and bytes of text in a bucket of the table of texts, about.
BUCKET_BYTES, TEXT_BYTES = 16 << 20, 64 << 20


class Blocks:
    """The blocks of a run of texts; block b covers the windows that start at word start[b] to start[b] + count[b] - 1."""

    def __init__(self, words: Words, width: int, kmer: int):
        n = len(words.hash)
        self.runs, self._width = Runs(words.hash), width
        starts, per = windows(words.first, width)
        self.start = self.count = self.offset = self.text = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if not len(starts):
            return
        keys = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        at = np.arange(n - kmer + 1)
        keys[: n - kmer + 1] = self.runs.of(at, at + kmer)
        low = self._leftmost(keys, width - kmer + 1)[starts]
        text = np.repeat(np.arange(len(per)), per)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(low) != 0) | (np.diff(text) != 0)]))
        self.start, self.count = starts[new], np.diff(np.concatenate([new, [len(starts)]]))
        self.anchor, self.offset, self.text = keys[low[new]], low[new] - starts[new], text[new]

    @staticmethod
    def _leftmost(keys: np.ndarray, span: int) -> np.ndarray:
        """Position of the smallest of keys[i : i + span], the leftmost on ties, by doubling."""
        best, reach = np.arange(len(keys)), 1
        while reach < span:
            step = min(reach, span - reach)
            other = np.concatenate([best[step:], best[len(best) - step :]])
            best = np.where(keys[other] < keys[best], other, best)
            reach += step
        return best

    def content(self) -> np.ndarray:
        """Hash of all words that the block's windows cover, and of where its anchor stands."""
        return mix(self.runs.of(self.start, self.start + self.count + self._width - 1) ^ mix(self.offset + 1))


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Sorted ids as the first and the steps."""
    return (ids[:1].tobytes() or bytes(8)) + _narrow(np.diff(ids).astype(np.uint64))


def _unpack_ids(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.int64, 1), _wide(raw[8:])]))[:n]


#: Blocks that were sent, edges that need no bucket, and blocks to be opened; ``counts`` of the first hold twice the count, plus one if the batch repeats the block.
SENT, EDGE, OPENED = 0, 1, 2
_PACKED = "bucket int, kind int, n int, first binary, second binary, ids binary, starts binary, counts binary"
_EDGE = "edge long, id long, start int, count int, kind int"


class Entries:
    """Entries (first, second: hashes; id, start, count), sorted by hashes, then by id and start."""

    def __init__(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, start: np.ndarray, count: np.ndarray):
        order = np.lexsort((start, ids, second, first))
        self.first, self.second, self.ids, self.start, self.count = (x[order] for x in (first, second, ids, start, count))
        n = len(order)
        self.new_first = np.ones(n, bool)
        self.new_first[1:] = self.first[1:] != self.first[:-1]
        self.new = self.new_first.copy()
        self.new[1:] |= self.second[1:] != self.second[:-1]
        self.lead = np.maximum.accumulate(np.where(self.new, np.arange(n), 0))
        #: entries that have an equal one before; not those that stand in the same place
        self.later = ~self.new & ((self.ids != self.ids[self.lead]) | (self.start != self.start[self.lead]))

    def repeated(self) -> np.ndarray:
        """Whether some entry equals this one."""
        return np.bincount(self.lead, self.later, len(self.lead))[self.lead] > 0

    def variants(self) -> np.ndarray:
        """For each entry: how many different second hashes its first one has."""
        group = np.cumsum(self.new_first) - 1
        return np.bincount(group[self.new], minlength=group[-1] + 1 if len(group) else 0)[group]

    def packed(self, chosen: np.ndarray, kind: int, buckets: int, keys: np.ndarray) -> Iterator[tuple]:
        """Rows of ``_PACKED`` of the chosen entries, dealt by the keys."""
        at = np.flatnonzero(chosen)
        bucket = (keys[at] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.ids[at], bucket))
        at, bucket = at[order], bucket[order]
        count = self.count * 2 + self.repeated() if kind == SENT else self.count
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(bucket)) + 1) if len(at) else ():
            own = at[part]
            yield int(bucket[part[0]]), kind, len(own), self.first[own].tobytes() if kind == SENT else b"", self.second[own].tobytes(), _pack_ids(self.ids[own]), _narrow(self.start[own]), _narrow(count[own])

    def edges(self, chosen: np.ndarray, kind: int) -> pa.RecordBatch:
        return _edges(self.second[chosen], self.ids[chosen], self.start[chosen], self.count[chosen], kind)


def _edges(edge: np.ndarray, ids: np.ndarray, start: np.ndarray, count: np.ndarray, kind: int) -> pa.RecordBatch:
    columns = (edge.view(np.int64), ids, start.astype(np.int32), count.astype(np.int32), np.full(len(ids), kind, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["edge", "id", "start", "count", "kind"])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int32()] * 3, *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "n", "first", "second", "ids", "starts", "counts"])


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    return (*[np.frombuffer(row[c], np.uint64) for c in ("first", "second")], _unpack_ids(row["ids"], row["n"]), _wide(row["starts"]), _wide(row["counts"]))


def _joined(parts: list[tuple]) -> Entries:
    return Entries(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def _sent_blocks(texts: DataFrame, width: int, kmer: int, buckets: int) -> DataFrame:
    """Blocks of (id, text), packed and dealt by their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for i, j, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                b = Blocks(words, width, kmer)
                parts.append((b.anchor, b.content(), ids[i:j][b.text], b.start - words.first[b.text], b.count))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            entries = _joined(parts)
            place = np.cumsum(entries.new)  # which content of its anchor in this batch
            place = place - np.maximum.accumulate(np.where(entries.new_first, place, 0))
            opened = entries.new & (entries.variants() > HOT) & (place >= 2)
            again = entries.later | opened & entries.repeated()
            rows = [*entries.packed(entries.new & ~opened, SENT, buckets, entries.first), *entries.packed(again, EDGE, buckets, entries.second), *entries.packed(opened, OPENED, buckets, entries.second)]
            yield _rows(rows)

    return texts.mapInArrow(run, _PACKED)


def _settled(parts: list[tuple]) -> tuple[Entries, np.ndarray]:
    """The entries of one bucket, and whether they occur more than once."""
    entries = _joined(parts)
    again = entries.count % 2 > 0
    entries.count = entries.count // 2
    return entries, entries.repeated() | (np.bincount(entries.lead, again, len(again))[entries.lead] > 0)


def _settled_blocks(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Repeated blocks are edges; where an anchor has several contents, the first block of each is opened."""
    entries, repeated = _settled(parts)
    yield entries.edges(entries.new & (entries.variants() > 1), OPENED)
    yield entries.edges(repeated, EDGE)


def _settled_windows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    entries, repeated = _settled(parts)
    yield entries.edges(repeated, EDGE)


def _sent_windows(asked: DataFrame, width: int, buckets: int) -> DataFrame:
    """Windows of the opened blocks of (id, packed text, blocks), packed and dealt by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, parts = batch.column(0).to_numpy(), _unzipped(batch.column(1)), []
            edge, (first, count) = _lists(batch.column(2), ("start", "count"))
            for i, j, data, offsets in text_slices(texts):
                words, own = Words(data, offsets), slice(edge[i], edge[j])
                per = count[own]
                text = np.repeat(np.repeat(np.arange(j - i), np.diff(edge[i : j + 1])), per)
                start = np.arange(per.sum()) + np.repeat(first[own] - np.cumsum(per) + per, per)
                fits = start + width <= np.diff(words.first)[text]  # another text of the same id can be longer
                text, start = text[fits], start[fits]
                at = words.first[text] + start
                parts.append((Runs(words.hash).of(at, at + width), Runs(mix(words.hash ^ np.uint64(0x5851F42D4C957F2D))).of(at, at + width), ids[i:j][text], start, np.ones(len(at), np.int64)))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            entries = _joined(parts)
            yield _rows([*entries.packed(entries.new, SENT, buckets, entries.first), *entries.packed(entries.later, EDGE, buckets, entries.second)])

    return asked.mapInArrow(run, _PACKED)


def _dealt(packed: DataFrame, parts: int, settle: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Every bucket in one partition, with others, one after the other; rows that no bucket decides on pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != SENT:
                    yield _edges(*_unpacked(row)[1:], row["kind"])
                    continue
                if row["bucket"] != bucket and held:
                    yield from settle(held)
                    held = []
                bucket = row["bucket"]
                held.append(_unpacked(row))
        if held:
            yield from settle(held)

    return packed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(run, _EDGE)


def _zip(x: str | None) -> bytes | None:
    return None if x is None else zstandard.ZstdCompressor(level=3, write_content_size=True).compress(x.encode())


def _unzipped(packed: pa.Array) -> pa.Array:
    decompress = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else decompress(x).decode() for x in packed.to_pylist()], pa.large_string())


def _zipped(docs: DataFrame) -> DataFrame:
    """(id, text, ...) with compressed texts: they move between machines."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, "text", pa.array([_zip(x) for x in batch.column(at).to_pylist()], pa.binary()))

    return docs.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'text' else t}" for c, t in docs.dtypes))


def _bucketed(docs: DataFrame, parts: int) -> DataFrame:
    """The compressed documents in a table that is bucketed by id in the shared folder.

    Its name leaves the catalogue at once: the frame that is returned keeps the files and their buckets.
    """
    spark, name = docs.sparkSession, f"tessera_texts_{uuid.uuid4().hex}"
    _zipped(docs).repartition(parts, "id").write.bucketBy(parts, "id").option("compression", "none").option("path", f"{run_dir(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"drop table {name}")
    return found


def _lists(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's part of an array of structs begins and ends, and the structs' fields."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fields = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [fields.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]


def repeated_edges(texts: DataFrame, zipped: DataFrame, width: int, kmer: int, parts: int, buckets: int) -> DataFrame:
    """(edge, id, start, count, single) of every occurrence of repeated blocks, and of repeated windows of opened blocks."""
    first = materialise(_dealt(_sent_blocks(texts, width, kmer, buckets), parts, _settled_blocks))
    blocks = first.where(f"kind = {OPENED}").groupBy("id").agg(F.collect_set(F.struct("start", "count")).alias("blocks"))  # as many as a document has
    windows_of = _dealt(_sent_windows(zipped.select("id", "text").join(blocks, "id"), width, buckets), parts, _settled_windows)
    edges = first.where(f"kind = {EDGE}").withColumn("single", F.lit(False)).unionByName(windows_of.withColumn("single", F.lit(True)))
    return edges.drop("kind")


def compacted(edges: DataFrame) -> DataFrame:
    """``edges``, each once, with path, the first edge of the nonbranching path that each is on, and where that begins.

    u and v are of one path if v follows u as often as either occurs: then every occurrence of a path is whole.
    """
    order = W.partitionBy("id", "single").orderBy("start", "edge")
    before = F.lag(F.struct("edge", "start", (F.col("start") + F.col("count")).alias("end"))).over(order)
    placed = edges.withColumn("b", before).where("b is null or b.edge != edge or b.start != start")
    placed = materialise(placed.select("edge", "id", "single", "start", "count", F.when(F.col("b.end") == F.col("start"), F.col("b.edge")).alias("u")))
    times = materialise(placed.groupBy("edge").agg(F.count(F.lit(1)).alias("n")))
    links = placed.where("u is not null").groupBy("u", F.col("edge").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    straight = links.join(times.withColumnRenamed("edge", "u"), ["u", "n"]).join(times.withColumnRenamed("edge", "v"), ["v", "n"])
    inner = materialise(straight.select(F.col("v").alias("edge"), F.lit(True).alias("inner")))
    begin = F.last(F.when(F.col("inner").isNull(), F.struct(F.col("edge").alias("path"), F.col("start").alias("begin"))), ignorenulls=True)
    return placed.drop("u").join(inner, "edge", "left").withColumn("b", begin.over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).select("edge", "id", "start", "count", "b.path", "b.begin")


def _word_digests(raw: bytes, starts: list[int], ends: list[int], first: list[int], last: list[int]) -> list[bytes | None]:
    """A digest of the words from ``first`` to before ``last`` for each span; None if the text ends before."""
    out = []
    for i, j in zip(first, last, strict=True):
        if j > len(starts):
            out.append(None)
        elif j - i <= 1 << 16:
            out.append(hashlib.blake2b(b" ".join(raw[starts[i] : ends[j - 1]].split()), digest_size=16).digest())
        else:
            digest = hashlib.blake2b(digest_size=16)
            for a in range(i, j, 1 << 16):
                digest.update((b" " if a > i else b"") + b" ".join(raw[starts[a] : ends[min(a + (1 << 16), j) - 1]].split()))
            out.append(digest.digest())
    return out


def verified(spans: DataFrame, zipped: DataFrame, width: int) -> DataFrame:
    """(path, id, start, count, digest) of (path, id, start, count): with the digest of the words that stand there."""
    asked = zipped.select("id", "text").join(spans.groupBy("id").agg(F.collect_list(F.struct("path", "start", "count")).alias("spans")), "id")  # as many as a document has
    names = ["path", "id", "start", "count", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge, (path, start, count) = _lists(batch.column(2), ("path", "start", "count"))
            ids, first, last = np.repeat(batch.column(0).to_numpy(), np.diff(edge)), start.tolist(), (start + count + width - 1).tolist()
            for i, j, data, offsets in text_slices(_unzipped(batch.column(1))):
                words, raw, digests = Words(data, offsets, hashed=False), data.tobytes(), []
                for k in range(i, j):
                    a, b = words.first[k - i], words.first[k - i + 1]
                    digests += _word_digests(raw, words.starts[a:b].tolist(), words.ends[a:b].tolist(), first[edge[k] : edge[k + 1]], last[edge[k] : edge[k + 1]])
                own = slice(edge[i], edge[j])
                found = pa.RecordBatch.from_arrays([pa.array(path[own]), pa.array(ids[own]), pa.array(start[own].astype(np.int32)), pa.array(count[own].astype(np.int32)), pa.array(digests, pa.binary())], names)
                yield found.filter(found.column("digest").is_valid())

    return materialise(asked.mapInArrow(run, "path long, id long, start int, count int, digest binary"))


def _repeats(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The verified spans of equal keys but for the first one by id and start."""
    first = spans.groupBy(*keys).agg(F.min(F.struct("id", "start")).alias("first"))
    return spans.join(first, list(keys)).where(F.struct("id", "start") != F.col("first")).select("id", "start", "count", "digest")


def repeated_spans(texts: DataFrame, zipped: DataFrame, width: int, kmer: int, parts: int, buckets: int) -> DataFrame:
    """(id, start, count, digest): long spans of windows that all start earlier too, and the digests of their words."""
    paths = materialise(compacted(repeated_edges(texts, zipped, width, kmer, parts, buckets)))
    spans = verified(paths.groupBy("path", "id", F.col("begin").alias("start")).agg(F.sum("count").cast("int").alias("count")), zipped, width)
    kinds = F.struct("count", "digest")
    known = materialise(spans.groupBy("path").agg((F.min(kinds) == F.max(kinds)).alias("same"), F.min(F.struct("id", "start")).alias("first")))
    sure = spans.join(known.where("same").select("path", "first"), "path").where(F.struct("id", "start") != F.col("first")).select("id", "start", "count", "digest")
    doubtful = known.where("not same").select("path")
    if not doubtful.limit(1).count():
        return sure
    edges = verified(paths.join(doubtful, "path").select(F.col("edge").alias("path"), "id", "start", "count"), zipped, width)
    return sure.unionByName(_repeats(edges, ("path", "count", "digest")))


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, count: np.ndarray, digests: list[bytes], width: int) -> tuple[int, bytes]:
    """How many words of a text go, and the kept ones joined by one space. Spans are compared with their digests first."""
    edge = np.zeros(len(starts) + 1, np.int64)
    if len(first):
        last = first + count + width - 1
        same = np.array([a == b for a, b in zip(_word_digests(raw, starts.tolist(), ends.tolist(), first.tolist(), last.tolist()), digests, strict=True)])
        np.add.at(edge, first[same], 1)
        np.add.at(edge, last[same], -1)
    keep = np.cumsum(edge[:-1]) == 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    runs = [b" ".join(raw[starts[a] : ends[b - 1]].split()) for a, b in zip(change[::2], change[1::2], strict=True)]
    return int(len(keep) - keep.sum()), b" ".join(runs)


def _cuts(texts: pa.Array, spans: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, bytes]]]]:
    """(first row, last row + 1, words of each, `_cut` of each) of texts and their arrays of spans."""
    edge, (first, count) = _lists(spans, ("start", "count"))
    digests = spans.flatten().field("digest").to_pylist()
    for i, j, data, offsets in text_slices(texts):
        words, raw = Words(data, offsets, hashed=False), data.tobytes()
        cut = [_cut(raw, words.starts[a:b], words.ends[a:b], first[x:y], count[x:y], digests[x:y], width) for a, b, x, y in zip(words.first, words.first[1:], edge[i:], edge[i + 1 : j + 1], strict=False)]
        yield i, j, np.diff(words.first), cut


def _marked(docs: DataFrame, width: int, kmer: int) -> DataFrame:
    """``docs`` of (id, text, ...), all with an id, with their texts compressed and the spans that go."""
    if not kmer <= width <= kmer + 30:
        raise ValueError("kmer <= width <= kmer + 30")
    texts = docs.select("id", "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = int(docs.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))  # beyond it, buckets grow: tasks read them in batches
    zipped = _bucketed(docs, min(most, max(parts, size // TEXT_BYTES)))
    spans = repeated_spans(texts, zipped, width, kmer, parts, max(parts, size // BUCKET_BYTES))
    return zipped.join(spans.groupBy("id").agg(F.collect_list(F.struct("start", "count", "digest")).alias("spans")), "id", "left")  # as many as a document has


def substring_dedup_digests(docs: DataFrame, width: int = WIDTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts earlier.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; earlier means a smaller id, or the same document and an
    earlier start. Returns id, n_words, n_removed and the digest of the kept words joined by one space. A
    null or empty text has no words; a text of fewer than ``width`` words loses none; a row without id is
    left as it is; rows that repeat an id are one document, whose equal places are no repeats of each
    other; an empty table gives an empty result; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = _marked(rows.where("id is not null"), width, kmer).select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, n, cut in _cuts(_unzipped(batch.column(1)), batch.column(2), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array([n for n, _ in cut], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, x in cut])], ["id", "n_words", "n_removed", "kept_sha256"])

    alone = _zipped(rows.where("id is null")).withColumn("spans", F.lit(None).cast(marked.schema["spans"].dataType))
    return marked.unionByName(alone).mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def substring_dedup(docs: DataFrame, width: int = WIDTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with repeated passages removed from its texts.

    A text that loses words becomes its kept words joined by one space, the empty text if none is kept; the
    others stay as they are, and so do rows without id. Columns may have any name.
    """
    arrow_batches(docs.sparkSession)
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = plain.withColumn("id", F.col(own_id).cast("long")).withColumn("text", F.col(own_text).cast("string")).drop(own_text)
    rest = [c for c in names if c != own_text]
    marked = _marked(rows.where("id is not null"), width, kmer).select(*rest, "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(len(rest) + 1), _unzipped(batch.column(len(rest)))
            out = texts.to_pylist()
            touched = np.flatnonzero(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for i, j, _, cut in _cuts(texts.take(pa.array(touched)), spans.take(pa.array(touched)), width):
                for k, (gone, kept) in zip(touched[i:j], cut, strict=True):
                    out[k] = kept.decode() if gone else out[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(out, pa.string())], [*rest, own_text])

    kinds = ", ".join([*[f"{c} {t}" for c, t in plain.dtypes if c != own_text], f"{own_text} string"])
    cut = marked.mapInArrow(run, kinds).withColumn(own_text, F.col(own_text).cast(plain.schema[own_text].dataType))
    return cut.select(*names).unionByName(plain.where(F.col(own_id).cast("long").isNull())).toDF(*docs.columns)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digests(table(spark, sf_dir, "documents"))
