"""Reading the input tables; the shared folder is that of the rest of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import passing, place, removed, shared_dir, stored

__all__ = ["integer_vectors", "passing", "place", "removed", "shared_dir", "shuffles", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int, most: int) -> DataFrame:
    """row_id (unlike for all rows), vec_id and v: floor(scale * x) of each component x, as double.

    Left out are null vectors, those with a null or non-finite component, and those with an integer of most or more in size, whose sums of products
    can be too large for a long. Rows are dealt evenly, however few files they come from and however many are alike.
    """
    x = F.col("x")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < most))
    rows = vectors.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("x")).where(whole)
    return rows.repartition(shuffles(vectors.sparkSession), "row_id").select("row_id", "vec_id", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))
