"""Monitors: what has changed since it was last looked at, over a table or over a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.lineage import place

#: Batches whose rows of the keys are made one at a time.
FOLD = 32


def changes(looks: DataFrame, key: list[str], at: str, seq: str, content: Column) -> DataFrame:
    """Every look with what it found: new, changed or same, by a digest of the content."""
    w = Window.partitionBy(*key).orderBy(at, seq)
    digest = F.sha2(content, 256)
    before = F.lag("digest").over(w)
    found = F.when(before.isNull(), "new").when(before == F.col("digest"), "same").otherwise("changed")
    return looks.withColumn("digest", digest).withColumn("found", found).select(seq, *key, "found")


def running_counts(looks: DataFrame, key: list[str], value: str) -> DataFrame:
    """Counts and sums by key over all that has come so far; for complete or update mode."""
    return looks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def windowed_counts(looks: DataFrame, at: str, kind: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by time window and kind. Rows that come later than the watermark allows are left out in append mode."""
    stamped = looks.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    out = stamped.groupBy(F.window("event_time", window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), kind, "n")


def _differs(a: Column, b: Column) -> Column:
    return F.coalesce(((a != b) & (a != "") & (b != "")).cast("long"), F.lit(0))


def batch_changes(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows (key, seq, digest): key, first and last digest in order of seq, looks and changed (how often a digest differs from the one before).

    Rows are dealt by ranges of key and seq, so those of a frequent key pass through many tasks; each task gives a row a key, and these are combined.
    """
    order = [*key, F.col("seq").asc_nulls_last(), "digest"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    n, names = len(key), [*key, "part", "first", "last", "looks", "changed"]
    schema = rows.select(*key).schema.add("part", "integer").add("first", "string").add("last", "string").add("looks", "long").add("changed", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for *k, digest, part in zip(*(b.column(i).to_pylist() for i in range(n + 2))):
                if now is None or now[:n] != k:
                    if now is not None:
                        done.append(now)
                    now = [*k, part, digest, digest, 0, 0]
                now[n + 4] += bool(digest and now[n + 2]) and digest != now[n + 2]
                now[n + 2], now[n + 3] = digest, now[n + 3] + 1
            yield packed(done)
        if now is not None:
            yield packed([now])

    kinds = to_arrow_schema(schema)

    def packed(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(kinds)], names)

    return folded(parts.select(*key, "digest", "part").mapInArrow(run, schema), key, "part")


def folded(parts: DataFrame, key: list[str], part: str) -> DataFrame:
    """One row a key of rows (key, part, first, last, looks, changed), which follow each other in order of part."""
    before = F.lag("last").over(Window.partitionBy(*key).orderBy(part))
    joined = parts.withColumn("changed", F.col("changed") + _differs(before, F.col("first")))
    return joined.groupBy(*key).agg(F.min_by("first", part).alias("first"), F.max_by("last", part).alias("last"), F.sum("looks").alias("looks"), F.sum("changed").alias("changed"))


def change_counts(looks: DataFrame, key: list[str], seq: str, content: Column, at: str | None = None) -> DataFrame:
    """For a stream, once it has read all there is: how often each key's content was looked at and how often it differed from the look before.

    Each batch adds a row for each of its own keys to a folder in at, so its work grows with the batch and not with all keys that there ever were; every ``FOLD`` batches the
    rows of the keys are made one. A batch that is run again writes its rows anew, so over a place in use the stream goes on and counts nothing twice. Rows of a batch are
    taken in order of seq; a look without content differs from none.
    """
    spark, at = looks.sparkSession, at or place(looks.sparkSession, "changes")
    rows = looks.select(*key, F.col(seq).alias("seq"), F.coalesce(F.sha2(content, 256), F.lit("")).alias("digest"))
    kept = T.StructType([*(rows.schema[k] for k in key), *T.StructType.fromDDL("first string, last string, looks long, changed long, batch long").fields])

    def read(upto: int | None = None) -> DataFrame:
        """Rows of the keys up to a batch: the last fold before it and what came after that."""
        both = [_parts(spark, f"{at}/{name}", kept) for name in ("folds", "batches")]
        if upto is not None:  # a fold that is made again doesn't start from itself
            both = [both[0].where(F.col("batch") < upto), both[1].where(F.col("batch") <= upto)]
        last = both[0].agg(F.max("batch")).first()[0]
        if last is None:
            return both[1]
        # a fold stands for its own batch and all before it
        return both[0].where(F.col("batch") == last).unionByName(both[1].where(F.col("batch") > last))

    def write(batch: DataFrame, number: int) -> None:
        batch_changes(batch, key).write.mode("overwrite").parquet(f"{at}/batches/batch={number}")
        if number % FOLD == FOLD - 1:
            folded(read(number), key, "batch").write.mode("overwrite").parquet(f"{at}/folds/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return folded(read(), key, "batch").select(*key, "looks", "changed")


def _parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written
        return spark.createDataFrame([], schema)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once it has read all there is: each batch's rows, in complete mode the last one's. Results are tables in the shared folder, and so is the stream's own state."""
    spark, at = df.sparkSession, place(df.sparkSession, "stream")
    schema = df.schema.add("batch", "long")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = _parts(spark, f"{at}/result", schema)
    if mode == "complete":  # each result holds those before it
        last = rows.select(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == (-1 if last is None else last))
    return rows.drop("batch")
