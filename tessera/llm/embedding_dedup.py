"""Operator 4: exact near-duplicate join of embeddings by metric partitioning.

Unit vectors with a cosine of at least t lie within r = sqrt(2 - 2 t) of each other. Pivots, a bounded
sample of the vectors, split the space into cells of the vectors nearest to each; by the triangle
inequality a vector within r of a cell's member is at most 2 r farther from that cell's pivot than from
its own, and the plane between the two pivots is within r. It is copied to the cells for which both hold,
but of two cells only to one: pairs of both meet there. So each pair is compared once at most, a cell's own
vectors with each other and with the copies, never copies with copies.

How many pivots pay is counted, not guessed: for numbers of cells that double, one pass counts the own
vectors and the copies of each cell, and each label takes the number with the fewest comparisons among those with at
most ``MOST_COPIES`` copies a vector. Vectors without structure have few cells, in the extreme one.

Vectors are scaled to unit length once, where they are read. Equal ones of a label are one class. Large
cells are compared in blocks of chunk against chunk; blocks return links counted per vector and a spanning
forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .jaccard_join import roots
from .kernels import arrow_batches, materialise, table

#: Bytes of all pivots at most (they go to all tasks), the rows of a chunk that one block compares with another chunk, and
#: the distances worked on at a time.
PIVOT_BYTES, CHUNK, STRIP = 32 << 20, 4096, 1 << 21
#: Copies of a vector, on average over a label, that a number of cells may cost.
MOST_COPIES = 2
#: Dimensions that have pivots, those of the most vectors; a table has one or few. Others are compared in blocks only.
DIMENSIONS = 16
#: Pivots that are chosen one after the other, far from those before; and vectors for each pivot among which they are chosen.
SPREAD_PIVOTS, SAMPLED = 1024, 4
#: Bytes of counts that a task holds before it passes them on.
HELD_BYTES = 32 << 20


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, label, k1, k2, dim, embedding) of (id, label, embedding): unit vectors and keys of their equality.

    Keys, dim and embedding are null for what links with nothing: null, empty and zero vectors, null or
    non-finite components, null ids and labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            named = pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))).to_numpy(zero_copy_only=False)
            dims = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            out: list = [None] * len(dims)
            for dim in np.unique(dims[named & (dims > 0)]):
                rows = np.flatnonzero(named & (dims == dim))
                x = pc.fill_null(lists.take(pa.array(rows)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
                most = np.abs(x).max(1)
                sound = np.isfinite(x).all(1) & (most > 0)
                x = x[sound] / most[sound][:, None]  # of length about 1: squares neither overflow nor vanish
                for row, v in zip(rows[sound].tolist(), x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0, strict=True):
                    out[row] = v
            keys = [None if v is None else np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16).digest(), np.int64).tolist() for v in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([k and k[n] for k in keys], pa.int64()) for n in (0, 1)], pa.array([None if v is None else len(v) for v in out], pa.int32()), pa.array(out, pa.list_(pa.float64()))],
                ["id", "label", "k1", "k2", "dim", "embedding"],
            )

    return vectors.mapInArrow(run, "id long, label string, k1 long, k2 long, dim int, embedding array<double>")


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def _strips(batch: pa.RecordBatch, pivots: dict[int, np.ndarray]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of one dimension each, so many that their distances from the pivots are ``STRIP`` at most."""
    for dim in np.unique(dims := batch.column("dim").to_numpy()):
        part = batch.filter(pa.array(dims == dim))
        step = max(1, STRIP // max(1, len(pivots.get(int(dim), ()))))
        for k in range(0, part.num_rows, step):
            yield int(dim), part.slice(k, step)


def _homes(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and the cells to which it is copied.

    Of two cells that are even or odd alike the higher one's vectors are copied to the lower, of others the
    lower one's to the higher: each pair of cells meets in one of them, and all cells get copies.
    """
    away = _distances(x, pivots)
    home = away.argmin(1)
    own, cell = away[np.arange(len(home)), home][:, None], np.arange(len(pivots))
    slack = 1e-6  # distances near 0 are exact to 1e-8
    near = (away <= own + 2 * radius + slack) & (away**2 - own**2 <= 2 * radius * _distances(pivots[home], pivots) + slack)
    alike = (home[:, None] + cell) % 2 == 0
    return home, near & np.where(alike, cell < home[:, None], cell > home[:, None])


def _ladder(pivots: int, vectors: int) -> list[int]:
    """1, 2, 4, ... cells, up to the number of pivots and twice the root of the vectors."""
    return [1 << k for k in range(max(1, pivots).bit_length()) if k == 0 or 1 << k <= 2 * vectors**0.5]


def _tallies(rows: DataFrame, shared, radius: float) -> DataFrame:
    """(label, dim, cells, cell, own, copies) of (label, dim, n, embedding), in part: to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (label, dim, cells), counts in held.items():
                at = np.flatnonzero(counts.any(0))
                same = [pa.array([v] * len(at), t) for v, t in ((label, pa.string()), (dim, pa.int32()), (cells, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["label", "dim", "cells", "cell", "own", "copies"])
            held.clear()

        for batch in batches:
            for dim, part in _strips(batch, shared.value):
                pivots = shared.value.get(dim, np.empty((0, dim)))
                x, coded = _matrix(part.column("embedding"), dim), part.column("label").dictionary_encode()
                code, n = coded.indices.to_numpy(), part.column("n").to_numpy()
                for c, label in enumerate(coded.dictionary.to_pylist()):
                    rows = np.flatnonzero(code == c)
                    for cells in _ladder(len(pivots), int(n[rows[0]])):
                        counts = held.setdefault((label, dim, cells), np.zeros((2, cells), np.int64))
                        if cells == 1:
                            counts[0] += len(rows)
                            continue
                        home, near = _homes(x[rows], pivots[:cells], radius)
                        counts[0] += np.bincount(home, minlength=cells)
                        counts[1] += near.sum(0)
                if sum(a.nbytes for a in held.values()) > HELD_BYTES:
                    yield from passed()
        yield from passed()

    return rows.select("label", "dim", "n", "embedding").mapInArrow(run, "label string, dim int, cells int, cell int, own long, copies long")


def _plan(sized: DataFrame, shared, radius: float, most_copies: float) -> DataFrame:
    """(label, dim, cells, vectors, copies, pairs): the number of cells with the fewest comparisons, those with pivots included."""
    each = _tallies(sized, shared, radius).groupBy("label", "dim", "cells", "cell").agg(F.sum("own").cast("double").alias("own"), F.sum("copies").cast("double").alias("copies"))
    pairs = F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("copies")
    cost = each.groupBy("label", "dim", "cells").agg(F.sum("own").alias("vectors"), F.sum("copies").alias("copies"), F.sum(pairs).alias("pairs")).where(F.col("copies") <= most_copies * F.col("vectors"))
    best = cost.groupBy("label", "dim").agg(F.min(F.struct((F.col("pairs") + F.col("vectors") * F.col("cells")).alias("cost"), "cells", "vectors", "copies", "pairs")).alias("b"))
    return best.select("label", "dim", "b.cells", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("vectors", "copies", "pairs")])


def _cells(rows: DataFrame, shared, radius: float) -> DataFrame:
    """One row for each cell that a vector of (..., dim, cells, embedding) belongs to or is copied to: those columns, cell and home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, strip in _strips(batch, shared.value):
                for cells in np.unique(wanted := strip.column("cells").to_numpy()):
                    part = strip.filter(pa.array(wanted == cells))
                    if cells == 1:
                        home, (row, cell) = np.zeros(part.num_rows, np.int64), np.empty((2, 0), np.int64)
                    else:
                        home, near = _homes(_matrix(part.column("embedding"), dim), shared.value[dim][:cells], radius)
                        row, cell = np.nonzero(near)
                    kept = part.take(pa.array(np.concatenate([np.arange(len(home)), row])))
                    cell = np.concatenate([home, cell]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell), pa.array(np.arange(len(cell)) < len(home))], [*kept.schema.names, "cell", "home"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, cell int, home boolean")


def _spread(x: np.ndarray, wanted: int) -> np.ndarray:
    """``wanted`` of the rows: each drawn with a chance in proportion to the square of its distance from those before.

    So clusters get a pivot each before any gets many. The first ``SPREAD_PIVOTS`` are drawn like that, others in the order of the rows.
    """
    rng, taken = np.random.default_rng(0), [0]
    away = np.maximum(0.0, 2 - 2 * (x @ x[0]))
    while len(taken) < min(wanted, SPREAD_PIVOTS, len(x)) and away.sum() > 1e-9:
        taken.append(int(rng.choice(len(x), p=away / away.sum())))
        away = np.minimum(away, np.maximum(0.0, 2 - 2 * (x @ x[taken[-1]])))
        away[taken[-1]] = 0.0
    return x[np.concatenate([taken, np.setdiff1d(np.arange(len(x)), taken)])[:wanted]]


def _pivots(sized: DataFrame, counts: DataFrame, pivot_bytes: int, cell: int | None) -> dict[int, np.ndarray]:
    """Pivots of the dimensions with the most vectors, from a sample by hash; each beginning of them is a choice of pivots as well."""
    top = counts.groupBy("dim").agg(F.max("n").alias("n"), F.sum("n").alias("all")).orderBy(F.desc("all"), "dim").limit(DIMENSIONS).collect()
    wanted = {r.dim: max(1, min(pivot_bytes // (8 * r.dim * len(top)), r.n // cell if cell else int(2 * r.n**0.5))) for r in top}

    def sample(dim: int, n: int) -> np.ndarray:
        rows = sized.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(max(n, SAMPLED * min(n, SPREAD_PIVOTS))).select("embedding").toArrow()
        return _spread(_matrix(rows["embedding"].combine_chunks(), dim), n)

    return {dim: sample(dim, n) for dim, n in wanted.items()}


def _classes(vectors: DataFrame, id_col: str, label_col: str | None, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Unit vectors, and their classes: (label, dim, k1, k2, rep, weight, embedding)."""
    arrow_batches(vectors.sparkSession)
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    rows = materialise(unit_vectors(vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))))
    return rows, materialise(rows.where("dim is not null").groupBy("label", "dim", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")))


def _placed(classes: DataFrame, threshold: float, cell: int | None, pivot_bytes: int, most_copies: float) -> tuple[DataFrame, DataFrame]:
    """The plan of each label, and the vectors in their cells."""
    counts = materialise(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    sized = classes.select(F.col("rep").alias("id"), "label", "weight", "dim", "embedding").join(counts, ["label", "dim"])
    pivots = _pivots(sized, counts, pivot_bytes, cell)
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    if cell:
        least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for dim, p in pivots.items() for x in (dim, len(p))]), F.col("dim")), F.lit(1)) if pivots else F.lit(1)
        plan = counts.select("label", "dim", F.greatest(F.lit(1), F.least(least, F.floor(F.col("n") / cell))).cast("int").alias("cells"))
    else:
        plan = _plan(sized, shared, radius, most_copies)
    plan = materialise(plan)
    return plan, materialise(_cells(sized.drop("n").join(plan.select("label", "dim", "cells"), ["label", "dim"]), shared, radius))


def metric_plan(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", label_col: str | None = "label", vector_col: str = "embedding", pivot_bytes: int = PIVOT_BYTES, most_copies: float = MOST_COPIES) -> DataFrame:
    """What `embedding_near_dedup` does with a table: (label, dim, cells, vectors, copies, pairs).

    ``vectors`` are the distinct ones of the label and dimension, ``copies`` the rows beside them, ``pairs`` the
    comparisons; without cells they were vectors (vectors - 1) / 2. Rows that link with nothing don't count; an empty table
    has no rows.
    """
    return _placed(_classes(vectors, id_col, label_col, vector_col)[1], threshold, None, pivot_bytes, most_copies)[0]


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", label_col: str | None = "label", vector_col: str = "embedding", cell: int | None = None, pivot_bytes: int = PIVOT_BYTES, chunk: int = CHUNK, most_copies: float = MOST_COPIES) -> DataFrame:
    """Link vectors of equal label and dimension whose cosine is at least ``threshold``, in double precision.

    Returns for each row: the id, n_links (other vectors linked directly, equal ones included),
    component_id (the smallest id reachable by links, itself included) and kept (id = component_id).
    Vectors that are null, empty, zero or hold null or non-finite components, rows with a null label and
    rows without id link with nothing. With ``label_col`` None all rows count as of one label. Rows that
    repeat an id count as copies; other columns are ignored; an empty table gives an empty result.

    The number of cells of a label is chosen by counts of comparisons and copies (`metric_plan` shows them), or
    such that a cell has about ``cell`` vectors. Results don't depend on it. Pivots take up to ``pivot_bytes``; beyond that
    cells grow, and their chunks are compared in more blocks.
    """
    keys = ["label", "dim", "k1", "k2"]
    rows, classes = _classes(vectors, id_col, label_col, vector_col)
    placed = _placed(classes, threshold, cell, pivot_bytes, most_copies)[1]

    def number(home: bool):
        return F.ceil(F.count_if(F.col("home") if home else ~F.col("home")) / chunk).cast("int")

    sizes = placed.groupBy("label", "dim", "cell").agg(number(True).alias("homes"), number(False).alias("copies"), F.count(F.lit(1)).alias("n")).where("homes > 0 and n > 1").drop("n")
    mixed = F.xxhash64("id")
    own = F.when(F.col("home"), F.pmod(mixed, "homes")).otherwise(F.col("homes") + F.pmod(mixed, F.greatest("copies", F.lit(1))))
    last = F.when(F.col("home"), F.col("homes") + F.col("copies")).otherwise(F.col("homes")) - 1
    chunked = placed.join(sizes, ["label", "dim", "cell"]).withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    blocks = chunked.select("label", "dim", "cell", "id", "weight", "embedding", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(group: pa.Table) -> pa.Table:
        """The pairs of two chunks, of which the first holds own vectors of the cell, or those within it: each is seen in no other block."""
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        ids, weight, own = (group[c].to_numpy()[order] for c in ("id", "weight", "own"))
        x = _matrix(group["embedding"].combine_chunks(), group["dim"][0].as_py())[order]
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for k in range(0, len(left), 256):  # a strip at a time: memory in proportion to one chunk
            part = left[k : k + 256]
            other = right[k:] if a == b else right
            near = x[part] @ x[other].T >= threshold
            if a == b:
                near &= other > part[:, None]
            links[other] += weight[part] @ near
            links[part] += near @ weight[other]
            i, j = np.nonzero(near)
            if len(i):
                low = roots(len(ids), np.concatenate([np.arange(len(ids)), part[i]]), np.concatenate([low, other[j]]))
        kept = (links > 0) | (low != np.arange(len(ids)))
        return pa.table({"id": ids[kept], "links": links[kept], "low": ids[low[kept]]})

    found = materialise(blocks.groupBy("label", "dim", "cell", "a", "b").applyInArrow(compare, "id long, links long, low long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    resolved = materialise(links.join(connected_components(found, "id", "low").withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("rep"), "links", "root"))
    named = rows.join(classes.select(*keys, "rep", "weight"), keys, "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    component = F.coalesce("root", "rep")
    return named.join(resolved, "rep", "left").select(F.col("id").alias(id_col), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))
