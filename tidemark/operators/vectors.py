"""Search by the cosine of vectors: rows in cells around centroids, and of these the nearest few for each query, or all that can matter.

Centroids are fitted on a bounded sample; every row is put in the cell of its nearest centroid. A cell's rows are packed into blocks of ``BLOCK``, and the queries that probe the
cell meet each of its blocks in a task of its own, so a cell that holds a third of all rows is worked on by many tasks. A block gives its best rows for each query; these are ranked together.
Vectors that are null, are of another length than dims, have a null or non-finite component, or have no length take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stored

#: Rows that centroids are fitted on, at most, drawn by a digest of the vector.
SAMPLE = 100_000
BLOCK, QUERIES = 4096, 512
DIGITS = 6


@dataclass(frozen=True)
class Cells:
    """rows: id, v (of length 1), cell and angle (to the centroid); centroids, of length 1; the largest angle and the number of blocks of each cell."""

    rows: DataFrame
    centroids: np.ndarray
    widths: np.ndarray


def units(vectors: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """id and v: the vectors at length 1."""
    x = F.col("x")
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).where(x.isNotNull() & whole)
    sized = rows.withColumn("size", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))).where("size > 0 and size < double('infinity')")
    return sized.select("id", F.transform("x", lambda c: c / F.col("size")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def fitted(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, cells: int = 64, sample: int = SAMPLE, seed: int = 7) -> Cells:
    """Every row in one of cells. Centroids, cells x dims numbers, and a number a cell are all that the driver holds."""
    rows = stored(units(vectors, vec_id, vector, dims), "units")
    some = rows.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample).select(array_to_vector("v").alias("features"))
    k = min(cells, some.count())
    if k == 0:
        return Cells(rows.selectExpr("id", "v", "0 as cell", "0D as angle"), np.zeros((0, dims)), np.zeros(0))
    if k == 1:
        middles = np.array([some.first().features.toArray()])
    else:
        middles = np.array(KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(some).clusterCenters())
    middles /= np.maximum(np.linalg.norm(middles, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cosines = _matrix(b.column(1)) @ middles.T
                cell = cosines.argmax(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(_angles(cosines[np.arange(len(b)), cell]))], ["id", "v", "cell", "angle"])

    dealt = stored(rows.mapInArrow(run, rows.select("id", "v").schema.add("cell", "integer").add("angle", "double")), "cells")
    widths = np.full(len(middles), -np.inf)
    for r in dealt.groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        widths[r.cell] = r.angle
    return Cells(dealt, middles, widths)


def _packed(rows: DataFrame, size: int, kept: str) -> DataFrame:
    """cell, ids and v (as bytes) of rows (id, v, cell), sorted by cell, in blocks of size at most of one cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cell = b.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(b)]
            for start, stop in zip(edges, edges[1:]):
                for i in range(start, stop, size):
                    cut = b.slice(i, min(size, stop - i))
                    yield pa.RecordBatch.from_arrays([cut.column(2)[:1], pa.array([cut.column(0).to_pylist()], pa.list_(cut.schema.field(0).type)), pa.array([_matrix(cut.column(1)).tobytes()], pa.binary())], ["cell", kept, "v"])

    return rows.select("id", "v", "cell").mapInArrow(run, f"cell int, {kept} array<{rows.schema['id'].dataType.simpleString()}>, v binary")


def _probes(queries: DataFrame, cells: Cells, probe: int | None, reach: float | None) -> DataFrame:
    """queries (id, v) once for each cell that they probe: the nearest ones, those that reach into the angle reach, or all."""
    middles, widths = cells.centroids, cells.widths

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cosines = _matrix(b.column(1)) @ middles.T
            if reach is not None:
                asked = _angles(cosines) - widths[None] <= reach + 1e-6
            else:
                order = np.argsort(-cosines, axis=1, kind="stable")[:, : probe or len(middles)]
                asked = np.zeros(cosines.shape, bool)
                np.put_along_axis(asked, order, True, axis=1)
            row, cell = np.nonzero(asked)
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    return queries.select("id", "v").mapInArrow(run, queries.select("id", "v").schema.add("cell", "integer"))


def _met(queries: DataFrame, cells: Cells, k: int | None, least: float | None) -> DataFrame:
    """query_id, vec_id and cosine of probing queries (id, v, cell) and the rows of their cells: the k best of each block, or those of least at least."""
    blocks = _packed(cells.rows.repartitionByRange("cell", F.xxhash64("v")).sortWithinPartitions("cell"), BLOCK, "ids").withColumn("at", F.monotonically_increasing_id())
    blocks = stored(blocks, "blocks")
    asked = _packed(queries.repartitionByRange("cell", F.xxhash64("v")).sortWithinPartitions("cell"), QUERIES, "asked").withColumnRenamed("v", "q")
    # each block of queries goes to each block of its cell, by the block's own number
    pairs = stored(asked.join(blocks.select("cell", "at"), "cell").select("at", "asked", "q"), "asked").join(blocks.select("at", "ids", "v"), "at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked_ids, q, ids, v in zip(*(b.column(n) for n in ("asked", "q", "ids", "v"))):
                a, c = np.frombuffer(q.as_py()).reshape(len(asked_ids), -1), np.frombuffer(v.as_py()).reshape(len(ids), -1)
                cosines = np.round(a @ c.T, DIGITS)
                if least is not None:
                    near = cosines >= least
                else:
                    near = cosines >= np.partition(cosines, -k, axis=1)[:, -k, None] if len(ids) > k else np.ones(cosines.shape, bool)
                row, col = np.nonzero(near)
                for i in range(0, len(row), 1 << 16):
                    r, x = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([asked_ids.values.take(pa.array(r)), ids.values.take(pa.array(x)), pa.array(cosines[r, x])], ["query_id", "vec_id", "cosine"])

    kind = cells.rows.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"query_id {kind}, vec_id {kind}, cosine double").where("query_id <> vec_id")


def _best(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return _met(asked, cells, k + 1, None).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "cosine")


def probes(cells: Cells, least: float = 0.95, k: int = 10, sample: int = 200, seed: int = 11) -> int:
    """How many cells a query has to probe so that the part least of the k nearest of some rows, drawn by a digest, is found; their exact results, sample * k rows, say it."""
    some = cells.rows.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample).select("id", "v")
    some = stored(some, "asked")
    exact = _best(_probes(some, cells, None, None), cells, k)
    found = exact.join(some.select(F.col("id").alias("query_id"), "v"), "query_id").join(cells.rows.select(F.col("id").alias("vec_id"), "cell"), "vec_id").select("v", "cell").collect()
    if not found:
        return len(cells.centroids)
    order = np.argsort(-(np.array([r.v for r in found]) @ cells.centroids.T), axis=1, kind="stable")
    places = np.sort((order == np.array([r.cell for r in found])[:, None]).argmax(1))
    return int(places[int(np.ceil(least * len(places))) - 1]) + 1


def nearest(cells: Cells, queries: str, k: int = 10, probe: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and cosine (to six places): for each row for whose id queries holds the k nearest other rows, ties by id; ids differ.

    With probe from as many cells, so some may be missing; without it from all, so the result is exact.
    """
    return _best(_probes(cells.rows.where(queries), cells, probe, None), cells, k)


def within(cells: Cells, queries: str, least: float) -> DataFrame:
    """query_id, vec_id and cosine of all other rows whose cosine, to six places, is least at least, for each row for whose id queries holds.

    Exact: a cell is passed over only if its centroid is farther from the query than its widest row and the asked angle together.
    """
    asked = _probes(cells.rows.where(queries), cells, None, float(_angles(np.array(least - 10.0**-DIGITS))))
    return _met(asked, cells, None, least)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """A row: of the rows of exact (query_id, vec_id) the part that is in found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.coalesce(F.sum("hit") / F.count(F.lit(1)), F.lit(1.0)).alias("recall"))
