"""Sketches of each day, kept in the shared folder and merged for any span of days without a look at the rows again.

A sketch of ids (theta) tells how many there are: exactly up to ``1 << LG_ENTRIES``, beyond that with a standard error of 1 in 64 (one over the square root of that
number). Sketches of two spans tell how many ids they share, too. A sketch of values (KLL) tells quantiles, off in rank by ``RANK_ERROR`` at most with a confidence of 99 in 100.
Both are of bounded size whatever the day has, are made in part before rows are shuffled, and give the same when they are merged in any order (values: within the same error).

Where an estimate won't do, the ids of each day are kept themselves (``daily_ids``), a row an id, and counted exactly for any span of days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base-2 logarithm of the entries of a sketch of ids, and the k of a sketch of values.
LG_ENTRIES, VALUES_K = 12, 400
RANK_ERROR = 0.01
#: Tasks that the ids of a day are dealt to.
DEALT = 16


def daily(rows: DataFrame, at: str, ids: str, values: str, *by: str) -> DataFrame:
    """day, by, n, ids and values: a row for each day and each of by. Rows without a time are left out; null ids and values are in no sketch."""
    sketches = F.theta_sketch_agg(ids, LG_ENTRIES).alias("ids"), F.kll_sketch_agg_double(F.col(values).cast("double"), VALUES_K).alias("values")
    return rows.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"), *sketches)


def keep(days: DataFrame, at: str) -> DataFrame:
    """Writes sketches to a folder, a partition a day, and gives all that it has. A day that it has already is replaced, so a run that is repeated counts nothing twice."""
    days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(at)
    return kept(days.sparkSession, at, days)


def daily_ids(rows: DataFrame, at: str, ids: str, *by: str) -> DataFrame:
    """day, by, id and n: a row for each day, each of by and each id, with how often it came. Rows without a time are left out; null is an id like any other."""
    return rows.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"), *by, F.col(ids).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def keep_ids(days: DataFrame, at: str) -> DataFrame:
    """Writes ids as ``keep`` writes sketches, but with a day's rows dealt to DEALT tasks."""
    dealt = days.repartition("day", F.pmod(F.xxhash64("id"), F.lit(DEALT)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(at)
    return kept(days.sparkSession, at, days)


def kept(spark: SparkSession, at: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(at)


def _from_to(days: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        days = days.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col("day") <= F.lit(last).cast("date"))
    return days


def span(days: DataFrame, first: str | None, last: str | None, *by: str) -> DataFrame:
    """by, n, ids and values of the days from first to last; only their partitions are read."""
    return _merged(_from_to(days, first, last), *by)


def span_ids(days: DataFrame, first: str | None, last: str | None, *by: str) -> DataFrame:
    """by, n and users (how many ids there are, without null) of the days from first to last, from kept ids; only their partitions are read."""
    return _from_to(days, first, last).groupBy(*by).agg(F.sum("n").alias("n"), F.count_distinct("id").alias("users"))


def _merged(days: DataFrame, *by: str) -> DataFrame:
    return days.groupBy(*by).agg(F.sum("n").alias("n"), F.theta_union_agg("ids", LG_ENTRIES).alias("ids"), F.kll_merge_agg_double("values", VALUES_K).alias("values"))


def rolling(days: DataFrame, length: int) -> DataFrame:
    """day, users and back for each day that there is: the ids of the length days that it ends, and those of them that the length days before had as well."""
    one = days.select("day", "ids")
    to = one.select("ids", F.explode(F.sequence(F.lit(0), F.lit(2 * length - 1))).alias("ago"), "day").select(F.expr("date_add(day, ago)").alias("day"), (F.col("ago") >= length).alias("before"), "ids")
    to = to.join(one.select("day").distinct(), "day", "left_semi")
    # two spans a day, of which either may have no sketch
    both = to.groupBy("day").agg(*(F.expr(f"theta_union_agg(ids, {LG_ENTRIES}) filter (where {which} before)").alias(name) for name, which in (("now", "not"), ("earlier", ""))))
    return both.select("day", F.theta_sketch_estimate("now").alias("users"), F.theta_sketch_estimate(F.theta_intersection("now", "earlier")).alias("back"))


def rolling_ids(days: DataFrame, length: int) -> DataFrame:
    """The rows of ``rolling``, exactly, from kept ids. Null is an id of a day, but not one that came back.

    Of each id its distinct days are gathered (no more than there are days), and the days whose spans they are in are counted in part before they are shuffled.
    """
    own = days.groupBy("id").agg(F.collect_set("day").alias("days"))
    now = F.array_distinct(F.flatten(F.transform("days", lambda d: F.sequence(d, F.date_add(d, length - 1)))))
    own = own.withColumn("now", now).withColumn("back", F.when(F.col("id").isNotNull(), F.array_intersect("now", F.transform("now", lambda d: F.date_add(d, length)))).otherwise(F.expr("cast(array() as array<date>)")))
    marks = [F.transform("now", lambda d: F.struct(d.alias("day"), F.lit(False).alias("again"))), F.transform("back", lambda d: F.struct(d.alias("day"), F.lit(True).alias("again")))]
    counts = own.select(F.explode(F.concat(*marks)).alias("x")).select("x.*").groupBy("day").agg(F.count_if(~F.col("again")).alias("users"), F.count_if("again").alias("back"))
    return counts.join(days.select("day").distinct(), "day", "left_semi")


def quantiles(merged: DataFrame, shares: list[float], *by: str) -> DataFrame:
    """by, share and value: the quantiles of sketches of values; groups without a value give none."""
    some = merged.where(F.kll_sketch_get_n_double("values") > 0)
    asked = (F.struct(F.lit(share).alias("share"), F.kll_sketch_get_quantile_double("values", F.lit(share)).alias("value")) for share in shares)
    return some.select(*by, F.explode(F.array(*asked)).alias("x")).select(*by, "x.*")


def rank_errors(rows: DataFrame, values: str, found: DataFrame, *by: str) -> DataFrame:
    """by, share, n and error: how far the ranks of quantiles are from their shares among the rows. found is a row for each of by and share, and is broadcast up to the size that Spark allows."""
    told = rows.where(F.col(values).isNotNull()).select(*by, F.col(values).cast("double").alias("own"))
    counts = told.groupBy(*by, "own").agg(F.count(F.lit(1)).alias("times"))
    met = counts.join(found, list(by))
    under, upto = (F.sum(F.when(c, F.col("times")).otherwise(0)) / F.sum("times") for c in (F.col("own") < F.col("value"), F.col("own") <= F.col("value")))
    off = F.greatest(under - F.col("share"), F.col("share") - upto, F.lit(0.0))
    return met.groupBy(*by, "share", "value").agg(F.sum("times").alias("n"), off.alias("error")).drop("value")
