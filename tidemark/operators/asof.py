"""Joins by time: the row that held at a moment, and all rows whose span a moment is in.

Time is cut into bins. Of each key and bin the rows of both sides are sorted once, and the last value is carried forward; what a bin begins with is the last value of
the key's bins before it, which are a row each. So a key with very many rows is worked on by as many tasks as it has bins, and nothing is compared with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _bin(micros: Column, width: int) -> Column:
    return F.floor(micros / width)


def width_of(rows: DataFrame, bin: str) -> int:
    return int(rows.sparkSession.sql(f"select unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {bin}) as m").first().m)


def as_of(rows: DataFrame, versions: DataFrame, key: list[str], at: str, since: str, values: list[str], ties: tuple[str, ...] = (), bin: str = "1 day") -> DataFrame:
    """rows with the values and the time (since) of the last version of their key that is not after them; null where there is none.

    Of versions at one time the last by ties holds. rows and versions may share no other columns than key; both times may be of the same name if values don't hold it. Rows with a null key or time have
    no version; versions with a null key or time never hold. Rows that repeat stay. bin is to be wide enough to have some rows of a key, and narrow enough to fit in a task.
    """
    width, names = width_of(rows, bin), rows.columns
    held = F.struct(*(F.col(v).alias(f"v{i}") for i, v in enumerate(values)), F.col(since).alias("since"))
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
    ids = [f"k{i}" for i in range(len(key))]
    left = rows.select(*keys, _micros(at).alias("t"), F.lit(1).alias("side"), F.struct(*names).alias("row"))
    right = versions.select(*keys, _micros(since).alias("t"), F.lit(0).alias("side"), held.alias("held"), F.struct(*(F.col(c) for c in (ties or values[:1]))).alias("tie"))
    right = right.where(" and ".join(f"{c} is not null" for c in [*ids, "t"]))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("bin", _bin(F.col("t"), width))
    # the last version of each key and bin, and the last one before each bin that has a row
    bins = both.groupBy(*ids, "bin").agg(F.max_by("held", F.when(F.col("side") == 0, F.struct("t", "tie"))).alias("last"))
    before = bins.select(*ids, "bin", F.last("last", ignorenulls=True).over(Window.partitionBy(*ids).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    starts = before.where("before is not null").select(*ids, "bin", F.lit(-1).alias("side"), F.col("before").alias("held"))
    inside = Window.partitionBy(*ids, "bin").orderBy("side0", "t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    walked = both.unionByName(starts, allowMissingColumns=True).withColumn("side0", F.when(F.col("side") == -1, 0).otherwise(1)).withColumn("found", F.last("held", ignorenulls=True).over(inside))
    out = walked.where("side = 1")
    none = F.col("t").isNull()
    for c in ids:
        none = none | F.col(c).isNull()
    return out.select(*(F.col("row")[n].alias(n) for n in names), *(F.when(~none, F.col("found")[f"v{i}"]).alias(v) for i, v in enumerate(values)), F.when(~none, F.col("found")["since"]).alias("since"))


def spans_at(rows: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, bin: str = "1 day") -> DataFrame:
    """Each row with each span of its key that it is in: from start on and before end. Both sides' columns, with key once; names besides it differ.

    A span is dealt to the bins that it reaches into, so the join is on key and bin; only in its first and last bin times are compared besides. Nulls in key or times join with nothing, a span that ends before
    it starts holds nothing.
    """
    width = width_of(rows, bin)
    points = rows.where(F.col(at).isNotNull()).withColumn("bin", _bin(_micros(at), width))
    first, last = _bin(_micros(start), width), _bin(_micros(end) - 1, width)
    dealt = spans.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(F.sequence(first, last)))
    return points.join(dealt, [*key, "bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bin")
