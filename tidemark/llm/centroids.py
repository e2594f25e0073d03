"""Centroid clustering with Yinyang bounds.

Rounds are those of plain k-means over integers, with the same clusters; the bounds only spare distances. The starting centroids
are put in groups once. For each vector an upper bound of the distance to its own centroid is kept, and one lower bound for each group of the distances to
its other centroids. When centroids move, the upper bound grows by how far the own one went, the lower ones shrink by the farthest move in their groups.

1. Global filter: where the upper bound is below all lower bounds (first as it is, then made exact) the cluster stays.
2. Group filter: only groups whose lower bound is not above the upper bound are looked at.
3. In these, centroids whose own move leaves the group's old bound above are passed over; the surviving ones are compared exactly.

Distances that decide are exact integers; bounds are rounded towards doubt, so ties go to the smaller number. Vectors and their bounds are a
table in the shared folder for each round, each deleted when the next one is whole. Centroids, k rows, are all that tasks and driver share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import integer_vectors, place, removed, table

K, ROUNDS, SCALE, SIZE = 40, 5, 256, 64
#: Centroids in a group, about.
GROUP = 10
#: Integers are below this in size: 64 squares of their differences fit a long.
MOST = 1 << 27
#: Up to this size sums of squares are exact as doubles.
DOUBLES = 1 << 22
#: Bounds are taken as this much worse than they were reckoned.
SLACK = 1e-9


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """Of k vectors, the smallest by the digest of 2:<vec_id>, in this order; repeated ids by their components, null ids last."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def grouped(centroids: np.ndarray, size: int = GROUP, rounds: int = 5) -> list[np.ndarray]:
    """The numbers of the centroids in groups of about size, by a few rounds of k-means over them, from seeds far from each other."""
    points = centroids.astype(float)
    seeds, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(seeds) < max(1, len(points) // size):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[seeds[-1]]) ** 2).sum(1))
    middles = points[seeds]
    for _ in range(rounds):
        of = ((points[:, None] - middles[None]) ** 2).sum(2).argmin(1)
        middles = np.array([points[of == g].mean(0) if (of == g).any() else m for g, m in enumerate(middles)])
    return [found for g in range(len(middles)) if len(found := np.flatnonzero(of == g))]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x and each of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < DOUBLES and x.shape[1] <= SIZE:
        a, b = x.astype(float), c.astype(float)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def least(d: np.ndarray, cluster: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The smallest distance to a group's centroids other than the own one, as a bound."""
    others = np.where(cluster[:, None] == group[None], np.inf, np.sqrt(d[:, group].astype(float)))
    return others.min(1) * (1 - SLACK)


def assign_all(x: np.ndarray, c: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower bounds of vectors that have none yet."""
    d = squared(x, c)
    cluster = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), cluster].astype(float)) * (1 + SLACK)
    return cluster, upper, np.stack([least(d, cluster, g) for g in groups], 1)


def assign_again(x: np.ndarray, c: np.ndarray, groups: list[np.ndarray], moves: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same once centroids have moved by moves, from the bounds before, and how many exact distances it took."""
    old, cluster = lower, cluster.copy()
    lower = np.stack([lower[:, g] - moves[members].max() for g, members in enumerate(groups)], 1)
    upper = upper + moves[cluster]
    rows = np.flatnonzero(upper * (1 + SLACK) + SLACK >= lower.min(1))
    own = ((x[rows] - c[cluster[rows]]) ** 2).sum(1)
    upper[rows] = np.sqrt(own.astype(float)) * (1 + SLACK)
    taken = len(rows)
    doubt = upper[rows] * (1 + SLACK) + SLACK >= lower[rows].min(1)
    rows, own = rows[doubt], own[doubt]
    before, best, number = cluster[rows], own.copy(), cluster[rows].copy()
    limit = upper[rows] * (1 + SLACK) + SLACK
    exact: dict[int, np.ndarray] = {}
    for g, members in enumerate(groups):
        open_rows = limit >= lower[rows, g]
        for j in members:
            left = old[rows, g] - moves[j]  # what is known of j without looking
            look = np.flatnonzero(open_rows & (before != j) & (limit >= left))
            bound = left * (1 - SLACK)
            if len(look):
                d = squared(x[rows[look]], c[j : j + 1])[:, 0]
                taken += len(look)
                bound[look] = np.sqrt(d.astype(float)) * (1 - SLACK)
                wins = (d < best[look]) | ((d == best[look]) & (j < number[look]))
                best[look[wins]], number[look[wins]] = d[wins], j
            bound[before == j] = np.sqrt(own[before == j].astype(float)) * (1 - SLACK)
            exact[int(j)] = bound
    for g, members in enumerate(groups):
        lower[rows, g] = np.stack([np.where(number == j, np.inf, exact[int(j)]) for j in members], 1).min(1)
    cluster[rows] = number
    upper[rows] = np.sqrt(best.astype(float)) * (1 + SLACK)
    return cluster, upper, lower, taken


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def assigned(rows: DataFrame, c: np.ndarray, groups: list[np.ndarray], moves: np.ndarray | None) -> DataFrame:
    """vec_id, v, cluster, upper, lower and looked (exact distances that a vector's batch took, on average) of rows that have the first two or, with moves, the first five."""
    names = ["vec_id", "v", "cluster", "upper", "lower", "looked"]
    schema = T.StructType(rows.select("vec_id", "v").schema.fields + T.StructType.fromDDL("cluster int, upper double, lower array<double>, looked double").fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(1), np.int64)
            if moves is None:
                *found, taken = *assign_all(x, c, groups), len(x) * len(c)
            else:
                *found, taken = assign_again(x, c, groups, moves, b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).copy(), _matrix(b.column(4), float))
            cluster, upper, lower = found
            bounds = pa.ListArray.from_arrays(np.arange(0, lower.size + 1, len(groups), dtype=np.int32), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, pa.array(np.full(len(x), taken / len(x)))], names)

    return rows.select(*names[: 2 if moves is None else 5]).mapInArrow(run, schema)


def moved(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """Each centroid as the exact floor of the mean of its vectors, those of empty clusters as they are. Sums are made in the tasks first; the driver sees a row a cluster."""
    out = c.copy()
    for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[j].cast("long")).alias(f"s{j}") for j in range(c.shape[1]))).collect():
        out[r.cluster] = [r[f"s{j}"] // r.n for j in range(c.shape[1])]
    return out


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and looked, a row for each vector that takes part.

    Those are the vectors of size components, none null or non-finite, or 2^27 or more once scaled. Rows that repeat each count. With fewer than k
    vectors there are as many centroids; without any there is no row. looked: exact distances that a row of its batch took in the last assignment.
    """
    spark = vectors.sparkSession
    at = place(spark, "yinyang")

    def kept(df: DataFrame, name: str, before: str | None = None) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        if before:
            removed(spark, f"{at}/{before}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    whole = integer_vectors(vectors.where(F.size(F.col(f"`{vector}`")) == size), vec_id, vector, scale, MOST).select("vec_id", "v")
    rows = kept(whole, "round-0")
    c = starts(rows, k)
    if not len(c):
        return rows.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256", "0D as looked")
    groups, moves = grouped(c), None
    for n in range(1, rounds + 2):
        rows = kept(assigned(rows, c, groups, moves), f"round-{n}", f"round-{n - 1}")
        if n <= rounds:
            new = moved(rows, c)
            moves = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + SLACK)
            c = new
    digests = [(j, row.tolist(), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for j, row in enumerate(c)]
    ends = spark.createDataFrame(digests, "cluster int, c array<long>, centroid_sha256 string")
    apart = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    out = rows.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", apart.alias("distance"), "centroid_sha256", "looked")  # a row a centroid
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total, totals = sum(int(r.s) for r in sums), spark.createDataFrame([(r.cluster, int(r.s)) for r in sums], "cluster int, cluster_inertia long")
    return out.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256", "looked")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters after 5 rounds."""
    return clustered(table(spark, sf_dir, "embeddings")).drop("looked")


_FAR = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_ASSIGN = f"select r, vec_id, v, arg_min(struct_pack(j, d), struct_pack(d, j)) as a from (select r, vec_id, v, j, {_FAR} as d from x, {{c}}) group by all"
_MOVE = "select j, coalesce(n.c, o.c) as c from {c} o left join (select j, list(m order by i) as c from (select a.j as j, i, floor(sum(v[i]) / count(*))::bigint as m from {a}, range(1, 65) as t(i) group by all) group by j) n using (j)"
_STEPS = [("c0", f"select row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1 as j, v as c from x order by j limit {K}")]
for _n in range(ROUNDS + 1):
    _STEPS.append((f"a{_n}", _ASSIGN.format(c=f"c{_n}")))
    if _n < ROUNDS:
        _STEPS.append((f"c{_n + 1}", _MOVE.format(c=f"c{_n}", a=f"a{_n}")))
OP13_SQL = (
    f"with x as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as v from embeddings where len(embedding) = {SIZE} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0), "
    + ", ".join(f"{name} as materialized ({text})" for name, text in _STEPS)
    + f" select vec_id, a.j::int as cluster, a.d::bigint as distance, sum(a.d) over (partition by a.j)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{ROUNDS} join c{ROUNDS} on a.j = c{ROUNDS}.j"
)
