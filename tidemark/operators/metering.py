"""Credits: what each user has used, and when a quota was passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(usage: DataFrame, user: str, at: str, seq: str, quota: int) -> DataFrame:
    """Every operation with its number in the user's month and whether it is over the quota."""
    month = F.date_trunc("month", F.col(at)).cast("timestamp_ntz")
    w = Window.partitionBy(user, "month").orderBy(at, seq)
    out = usage.select(seq, user, at, month.alias("month")).withColumn("used", F.row_number().over(w).cast("long"))
    return out.select(seq, user, "month", "used", (F.col("used") > quota).alias("over_quota"))


def monthly(usage: DataFrame, user: str, at: str, kind: str, quota: int) -> DataFrame:
    """Per user and month: operations, kinds of them, credits left and credits over the quota."""
    month = F.date_trunc("month", F.col(at)).cast("timestamp_ntz")
    out = usage.groupBy(user, month.alias("month")).agg(F.count(F.lit(1)).alias("used"), F.count_distinct(kind).alias("kinds"))
    return out.select(user, "month", "used", "kinds", F.greatest(quota - F.col("used"), F.lit(0)).cast("long").alias("left_over"), F.greatest(F.col("used") - quota, F.lit(0)).cast("long").alias("over"))


def by_kind(usage: DataFrame, at: str, kind: str) -> DataFrame:
    """Operations by month and kind, with subtotals: null stands for all."""
    month = F.date_trunc("month", F.col(at)).cast("timestamp_ntz")
    return usage.select(month.alias("month"), F.col(kind).alias("kind")).rollup("month", "kind").agg(F.count(F.lit(1)).alias("used"))
