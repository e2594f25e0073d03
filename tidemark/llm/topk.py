"""Exact top-k search by inner product with vector-approximation files.

1. Cells: a grid of ``2 ** BITS`` cells a dimension, from the mean, spread and ends of all vectors there. The approximation file keeps a byte a dimension for each vector.
2. Scan: blocks of queries meet blocks of approximations, a part of these in each task. From the ends of its cells each vector has a bound of its
   score from above and one from below. A task passes over its blocks once and keeps for each query what is not below its k-th best lower bound so far; over all parts the k-th best lower bound decides again.
3. Exact vectors are read in order of the upper bounds, the first ``FIRST`` * k of each query, then those whose upper bound is not below the k-th score found. What
   is left is below k known scores, so the result is certain.

Of equal vectors only the k + 1 smallest ids can be among the best of a query (one of them may be the query itself), so copies beyond that are left out at the start;
where bounds are exact, ties are cut by id. No result is lost by either.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import integer_vectors, shuffles, stored, table

K, SCALE, EVERY = 20, 64, 20
BITS = 6
#: Vectors of a block of approximations, of a block of queries, and queries that are compared with a block at once.
BLOCK, QUERIES, AT_ONCE = 8192, 1024, 128
#: How often k exact vectors of a query are read at first.
FIRST = 2
#: Integers are below this in size, so that 64 products of two fit a long.
MOST = 1 << 28
#: Cells on either side of a dimension's mean reach this many standard deviations; the outermost ones hold what is beyond.
REACH = 4.0
#: Bounds are taken as this much wider than reckoned, relative to the products' sizes, where they are too large to be exact as doubles.
SLACK = 2.0**-44


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, with zeros behind the shorter ones."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lists) and (lengths == width).all():
        return flat.reshape(len(lists), width).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None] < lengths[:, None]] = flat
    return out


class Grid:
    """Cells of each dimension: the smallest and the largest integer that is in each of them."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high

    @staticmethod
    def over(ends: list[tuple[int, int, float, float]], bits: int = BITS) -> Grid:
        """Of a smallest and largest integer, a mean and a deviation for each dimension."""
        n, lows, highs = 1 << bits, [], []
        for smallest, largest, mean, spread in ends:
            a, b = max(smallest, int(mean - REACH * spread) - 1), min(largest, int(mean + REACH * spread) + 1)
            width = max(1, -(-(b - a + 1) // n))
            low = a + width * np.arange(n)
            high = np.minimum(low + width - 1, largest)
            low[0], high[np.searchsorted(low, b, "right") - 1 :] = smallest, largest
            lows.append(low)
            highs.append(high)
        return Grid(np.array(lows, np.int64).reshape(len(ends), n), np.array(highs, np.int64).reshape(len(ends), n))

    def cells(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(v.shape, np.uint8)
        for j in range(v.shape[1]):
            out[:, j] = np.maximum(np.searchsorted(self.low[j], v[:, j], "right") - 1, 0)
        return out

    def ends(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(cells.shape[1])
        return self.low[at, cells], self.high[at, cells]


def grid_of(vectors: DataFrame, width: int, bits: int = BITS) -> Grid:
    """The grid for rows (v); a row a task and dimension is all that is summed up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, s, squares = 0, np.full(width, MOST), np.full(width, -MOST), np.zeros(width), np.zeros(width)
        for b in batches:
            if len(b):
                v = matrix(b.column(0), width)
                n, low, high = n + len(v), np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
                s, squares = s + v.sum(0), squares + (v.astype(float) ** 2).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(low), pa.array(high), pa.array(s), pa.array(squares)], ["at", "n", "low", "high", "s", "squares"])

    parts = vectors.select("v").mapInArrow(run, "at long, n long, low long, high long, s double, squares double")
    mean = F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("squares") / F.sum("n") - mean * mean, F.lit(0.0)))
    rows = parts.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"), mean.alias("mean"), spread.alias("spread")).orderBy("at").collect()  # a row a dimension
    return Grid.over([(r.low, r.high, r["mean"], r.spread) for r in rows], bits)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the inner product of each query and each vector between low and high: a bound from below and one from above."""
    up, down, a, b = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float), low.astype(float), high.astype(float)
    lower, upper = up @ a.T + down @ b.T, up @ b.T + down @ a.T
    size = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0)), 1.0) * q.shape[1]
    if size >= 2.0**52:
        lower, upper = lower - size * SLACK, upper + size * SLACK
    return lower, upper


class Best:
    """For some queries what can still be among their k best: candidates with both bounds, cut when they grow."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.kth = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.after = 0, 0

    def add(self, query: np.ndarray, row: np.ndarray, place: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        self.parts.append((query, row, place, lower, upper))
        self.size += len(query)
        if self.size > 2 * self.after + 64 * self.n * self.k:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Drops what has k better ones: a lower bound above its upper one, or equal to it with a smaller place."""
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float))
        query, row, place, lower, upper = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((place, -lower, query))
        first = np.searchsorted(query[order], np.arange(self.n))
        at = first + self.k - 1
        full = np.bincount(query, minlength=self.n) >= self.k
        kth, kth_place = np.full(self.n, -np.inf), np.full(self.n, np.iinfo(np.int64).max)
        kth[full], kth_place[full] = lower[order[at[full]]], place[order[at[full]]]
        self.kth = kth
        keep = (upper > kth[query]) | ((upper == kth[query]) & (place <= kth_place[query]))
        self.parts = [tuple(x[keep] for x in (query, row, place, lower, upper))]
        self.size = self.after = int(keep.sum())
        return self.parts[0]


def scanned(blocks: DataFrame, grid: Grid, k: int) -> DataFrame:
    """Candidates (query, row_id, place, lower, upper) of rows (batch, part, kind, rows, places, v), sorted so that a batch's queries come before its approximations.

    rows, places: row ids and places as 64-bit integers; v: of queries 64-bit integers, of others cells.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, q, best = None, np.zeros(0, np.int64), np.zeros((0, 0), np.int64), None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                query, row, place, lower, upper = best.cut()
                for i in range(0, len(query), 1 << 16):
                    cut = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[query[cut]], row[cut], place[cut], lower[cut], upper[cut])], ["query", "row_id", "place", "lower", "upper"])

        for b in batches:
            for batch, part, kind, rows, places, v in zip(*(b.column(i) for i in range(6))):
                key = (batch.as_py(), part.as_py())
                row, place = np.frombuffer(rows.as_py(), np.int64), np.frombuffer(places.as_py(), np.int64)
                if kind.as_py() == 0:
                    if key != now:
                        yield from done()
                    now, ids, q = key, row, np.frombuffer(v.as_py(), np.int64).reshape(len(row), -1)
                    best = Best(len(ids), k)
                    continue
                low, high = grid.ends(np.frombuffer(v.as_py(), np.uint8).reshape(len(row), -1))
                for i in range(0, len(ids), AT_ONCE):
                    lower, upper = bounds(q[i : i + AT_ONCE], low, high)
                    own = ids[i : i + AT_ONCE, None] == row[None]
                    lower[own] = upper[own] = -np.inf
                    floor = best.kth[i : i + AT_ONCE].copy()
                    if lower.shape[1] > k:
                        floor = np.maximum(floor, np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k])
                    at, near = np.nonzero((upper >= floor[:, None]) & (upper > -np.inf))
                    best.add(at + i, row[near], place[near], lower[at, near], upper[at, near])
        yield from done()

    return blocks.mapInArrow(run, "query long, row_id long, place long, lower double, upper double")


def packed(rows: DataFrame, width: int, size: int, number: str, grid: Grid | None) -> DataFrame:
    """Rows (row_id, place, v) in blocks of size at most: their number (unlike for all blocks of rows), rows, places and v as bytes, cells with a grid."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), size):
                cut = b.slice(i, size)
                v = matrix(cut.column(2), width)
                ids, places = (cut.column(j).to_numpy().astype(np.int64) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary()), pa.array([(grid.cells(v) if grid else v).tobytes()], pa.binary())], [number, "rows", "places", "v"])

    return rows.select("row_id", "place", "v").mapInArrow(run, f"{number} long, rows binary, places binary, v binary")


def top(vectors: DataFrame, queries: str, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of the greatest inner product with each row for which queries, a condition on vec_id, holds, but itself.

    Components are floor(scale * x). A vector that is null, has a null or non-finite component or, once scaled, one of 2^28 or more in size takes no part.
    A shorter vector counts as one with zeros behind it. Ties go to the smaller vec_id, null last. Rows that repeat are rows of their own: each of them is a candidate
    for the others, and each that is a query has its results. With fewer than k candidates a query has them all; without any it has no row.
    """
    spark = vectors.sparkSession
    rows = stored(integer_vectors(vectors, vec_id, vector, scale, MOST), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    tasks = shuffles(spark)
    digest = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)
    copies = Window.partitionBy("digest").orderBy(F.col("vec_id").asc_nulls_last(), "row_id")
    # a vec_id may be null or no integer, so ties are cut by its place among all
    useful = rows.withColumn("digest", digest).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("row_id", "vec_id", "v")
    order = [F.col("vec_id").asc_nulls_last(), "row_id"]
    ordered = useful.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("row_id", "vec_id", "v", F.monotonically_increasing_id().alias("place"))
    ordered = stored(ordered, "ordered")
    grid = grid_of(ordered, width, bits)
    asked = stored(rows.where(queries), "queries")
    batches = stored(packed(asked.withColumn("place", F.lit(0).cast("long")).coalesce(max(1, -(-asked.count() // QUERIES))), width, QUERIES, "first", None), "asked")
    # batches are numbered without their vectors; each block of approximations is sent to each of them
    numbered = batches.join(batches.select("first", (F.row_number().over(Window.orderBy("first")) - 1).alias("batch")), "first")
    n = batches.count()
    parts = max(1, -(-2 * tasks // max(n, 1)))
    heads = numbered.select("batch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "rows", "places", "v")
    files = stored(packed(ordered, width, BLOCK, "block", grid), "cells")
    sent = files.select(F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("batch"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "rows", "places", "v")
    both = heads.unionByName(sent).repartition(max(tasks, n * parts), "batch", "part").sortWithinPartitions("batch", "part", "kind")
    found = stored(scanned(both, grid, k), "candidates")
    # what all parts know together cuts again
    by_lower = Window.partitionBy("query").orderBy(F.col("lower").desc(), "place")
    whole = by_lower.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth, kth_place = F.nth_value("lower", k).over(whole), F.nth_value("place", k).over(whole)
    by_upper = Window.partitionBy("query").orderBy(F.col("upper").desc(), "place")
    left = found.withColumn("kth", kth).withColumn("kth_place", kth_place).where("kth is null or upper > kth or (upper = kth and place <= kth_place)").withColumn("turn", F.row_number().over(by_upper))
    left = stored(left.select("query", "row_id", "upper", "turn"), "bounded")

    def exact(pairs: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a.cast("long") * b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
        sides = pairs.join(ordered.select("row_id", "vec_id", "v"), "row_id").join(asked.select(F.col("row_id").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query")
        return sides.select("query", "query_id", "row_id", "vec_id", product.alias("score"))

    early = stored(exact(left.where(F.col("turn") <= FIRST * k)), "exact")
    certain = early.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))).where(F.col("n") == k).select("query", F.col("score").alias("least"))
    late = exact(left.where(F.col("turn") > FIRST * k).join(certain, "query").where("upper >= least"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row_id")
    ranked = early.unionByName(late).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every one whose id is divisible by 20."""
    return top(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), f"vec_id % {EVERY} = 0")


OP12_SQL = f"""
with x as (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (select q.r, q.vec_id as query_id, x.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint as score, x.r as other from x q join x on q.r <> x.r where q.vec_id % {EVERY} = 0)
select query_id, (row_number() over (partition by r order by score desc, vec_id nulls last, other))::int as rank, vec_id, score from s qualify rank <= {K}
"""
