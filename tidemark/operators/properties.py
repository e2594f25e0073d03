"""Properties of rows as variants: JSON text parsed once and kept in Parquet as such, fields by path, and what paths there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored


def parsed(rows: DataFrame, json: str) -> DataFrame:
    """rows with the JSON text of a column as a variant, written to the shared folder. Null and what is no JSON is null."""
    return stored(rows.withColumn(json, F.try_parse_json(F.col(json))), "properties")


def fields(rows: DataFrame, variant: str, keep: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """keep and a column for each name of wanted, (path, type); null where there is no such path or what is there is not of that type."""
    return rows.select(*keep, *(F.try_variant_get(F.col(variant), path, kind).alias(name) for name, (path, kind) in wanted.items()))


def paths(rows: DataFrame, variant: str) -> DataFrame:
    """path, kind and n: how often each path holds a value of each kind (OBJECT, ARRAY, BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID for JSON's null).

    A path starts with $; a field adds its name after a dot, elements of an array [*]. A level of all values is taken apart at a time, as often as
    values are nested, and their counts are added up before a shuffle, so that a path that all rows have is no hot key.
    """
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("kind")
    level = rows.select(F.lit("$").alias("path"), F.col(variant).alias("value")).where("value is not null").select("path", "value", kind)
    counts = []
    while True:
        level = stored(level, "level")
        seen = level.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
        if level.isEmpty():
            counts.append(seen)
            break
        counts.append(seen)
        # rows of the level that have something within
        within = level.where("kind in ('OBJECT', 'ARRAY')").select("path", "value")
        inner = within.lateralJoin(within.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("place", "key", "inner"))
        step = F.when(F.col("key").isNull(), F.lit("[*]")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select(F.concat("path", step).alias("path"), F.col("inner").alias("value")).select("path", "value", kind)
    return reduce(DataFrame.unionByName, counts)


def schema(rows: DataFrame, variant: str) -> str | None:
    """One type, as text, that all values of a variant column have in common."""
    return rows.agg(F.schema_of_variant_agg(variant)).first()[0]
