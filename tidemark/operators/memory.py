"""A shared memory as an append-only log: who wrote what and when, what holds now or held then, and ways back.

Nothing is ever rewritten: undo and rollback give rows to append. A log has one row for each write; a null value is a removal.
What holds at a time is an aggregate with partial sums in each task, so neither sorts nor gathers a key's rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import receipt
from ..plans import commits


@dataclass(frozen=True)
class Log:
    """A table of writes and the names of its columns. Writes of a key are in order of at, then seq."""

    rows: DataFrame
    keys: tuple[str, ...] = ("key",)
    value: str = "value"
    writer: str = "writer"
    at: str = "at"
    seq: str = "seq"

    @property
    def columns(self) -> list[str]:
        return [*self.keys, self.value, self.writer, self.at, self.seq]

    @property
    def order(self) -> Column:
        return F.struct(self.at, self.seq)

    def until(self, time: str | None) -> DataFrame:
        return self.rows if time is None else self.rows.where(F.col(self.at) <= F.lit(time).cast("timestamp_ntz"))


def history(log: Log) -> DataFrame:
    """Every write with its version (from 1) and the time span in which it held; valid_to is null for what still holds."""
    w = Window.partitionBy(*log.keys).orderBy(log.at, log.seq)
    return log.rows.select(
        *log.keys, F.col(log.value).alias("value"), F.col(log.writer).alias("writer"), F.row_number().over(w).cast("long").alias("version"),
        F.col(log.at).alias("valid_from"), F.lead(log.at).over(w).alias("valid_to"),
    )


def state(log: Log, time: str | None = None) -> DataFrame:
    """What holds at a time (now, if none is given): keys, value, writer, written_at. Removed keys are not in it."""
    last = F.max_by(F.struct(F.col(log.value).alias("value"), F.col(log.writer).alias("writer"), F.col(log.at).alias("written_at")), log.order)
    return log.until(time).groupBy(*log.keys).agg(last.alias("last")).select(*log.keys, "last.*").where("value is not null")


def provenance(log: Log) -> DataFrame:
    """For each key and writer: how many writes, the first and the last."""
    return log.rows.groupBy(*log.keys, F.col(log.writer).alias("writer")).agg(F.count(F.lit(1)).alias("writes"), F.min(log.at).alias("first_at"), F.max(log.at).alias("last_at"))


def shared(log: Log) -> DataFrame:
    """For each writer: keys it wrote, keys whose present value is its own, writes."""
    wrote = log.rows.groupBy(F.col(log.writer).alias("writer")).agg(F.count_distinct(F.struct(*log.keys)).alias("keys_written"), F.count(F.lit(1)).alias("writes"))
    holds = state(log).groupBy("writer").agg(F.count(F.lit(1)).alias("keys_held"))
    return wrote.join(holds, "writer", "left").select("writer", "keys_written", "writes", F.coalesce("keys_held", F.lit(0)).cast("long").alias("keys_held"))


def changes(log: Log, before: str, after: str) -> DataFrame:
    """What differs between two times: keys, old_value, new_value and change (added, removed, changed or same)."""
    old = state(log, before).select(*log.keys, F.col("value").alias("old_value"))
    new = state(log, after).select(*log.keys, F.col("value").alias("new_value"))
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") == F.col("new_value"), "same").otherwise("changed")
    return old.join(new, list(log.keys), "full").select(*log.keys, "old_value", "new_value", kind.alias("change"))


def undo(log: Log) -> DataFrame:
    """For each key the write that takes back its last one: keys and the value before it, null where there was none.

    The two last writes are kept by an aggregate of pairs, not by sorting a key's rows.
    """
    last = F.max_by(F.struct(F.col(log.value).alias("value"), log.order.alias("place")), log.order)
    tops = log.rows.groupBy(*log.keys).agg(last.alias("last"))
    rest = log.rows.join(tops.select(*log.keys, F.col("last.place").alias("place")), list(log.keys)).where(log.order < F.col("place"))
    before = rest.groupBy(*log.keys).agg(F.max_by(log.value, log.order).alias("value"))
    return tops.select(*log.keys, F.col("last.value").alias("undone_value")).join(before, list(log.keys), "left")


def rollback(log: Log, time: str) -> DataFrame:
    """The writes that bring back what held at a time: keys, value (null: remove) and action (keep, restore or delete)."""
    now, then = state(log).select(*log.keys, F.col("value").alias("now_value")), state(log, time).select(*log.keys, F.col("value").alias("value"))
    action = F.when(F.col("value").isNull(), "delete").when(F.col("now_value").eqNullSafe(F.col("value")), "keep").otherwise("restore")
    return now.join(then, list(log.keys), "full").select(*log.keys, "value", action.alias("action"))


def appended(log: Log, writes: DataFrame, writer: str | None, time: str) -> Log:
    """The log with writes (keys and value) appended under one writer and time, after all that is in it at that time."""
    kinds = {f.name: f.dataType for f in log.rows.schema.fields}
    seq = (log.rows.agg(F.max(log.seq)).first()[0] or 0) + 1
    new = writes.select(*log.keys, F.col("value").cast(kinds[log.value]).alias(log.value), F.lit(writer).cast(kinds[log.writer]).alias(log.writer), F.lit(time).cast("timestamp_ntz").cast(kinds[log.at]).alias(log.at), F.lit(seq).cast(kinds[log.seq]).alias(log.seq))
    return replace(log, rows=log.rows.select(*log.columns).unionByName(new))


def opened(log: Log, path: str, commit: int | None = None) -> Log:
    """The log that is kept at path, as of now or of an earlier commit; log gives names and types of its columns."""
    spark, schema = log.rows.sparkSession, log.rows.select(*log.columns).schema
    batches = commits.state(spark, path, commit).batches
    if not batches:
        return replace(log, rows=log.rows.select(*log.columns).limit(0))
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).option("basePath", f"{path}/data").parquet(*(f"{path}/data/batch={name}" for name in batches))
    numbers = spark.createDataFrame(list(batches.items()), "batch string, number long")
    # a row a batch is broadcast: a shuffle by batch would send all rows of a batch to one task; rows of a batch that was appended have no number but that of its commit
    rows = read.join(F.broadcast(numbers), "batch").withColumn(log.seq, F.coalesce(F.col(log.seq), F.col("number").cast(schema[log.seq].dataType)))
    return replace(log, rows=rows.select(*log.columns))


def saved(log: Log, path: str) -> Log:
    """The log written to path, in the shared folder, as its first batch, and read from there. Fails where there is one."""
    spark, name = log.rows.sparkSession, uuid.uuid4().hex
    log.rows.select(*log.columns).write.parquet(f"{path}/data/batch={name}")
    top = spark.read.parquet(f"{path}/data/batch={name}").agg(F.max(log.seq)).first()[0]
    commits.committed(spark, path, name, int(top or 0), first=True)
    return opened(log, path)


def append(log: Log, path: str, writes: DataFrame, writer: str | None, time: str, job: str | None = None) -> Log:
    """Appends writes (keys and value) to the log at path, as a batch of its own that nothing ever rewrites; the log with it.

    Any number of writers may append at once, from any number of sessions: each batch gets a commit and a seq of its own, one more than any before it, and none is lost. A job
    names a batch that is to be appended once: where it has been, by whatever run, nothing happens.
    """
    spark, name, schema = log.rows.sparkSession, uuid.uuid4().hex, log.rows.schema
    if job is not None and job in commits.state(spark, path).jobs:
        return opened(log, path)
    values = {log.value: F.col("value"), log.writer: F.lit(writer), log.at: F.lit(time).cast("timestamp_ntz"), log.seq: F.lit(None)}
    writes.select(*log.keys, *(c.cast(schema[n].dataType).alias(n) for n, c in values.items())).write.parquet(f"{path}/data/batch={name}")
    commits.committed(spark, path, name, job=job)
    return opened(log, path)


def compacted(log: Log, path: str) -> Log:
    """The log with all of its batches in one, in a commit of its own. Batches that others append meanwhile stay beside it; earlier commits can be read as before."""
    spark, now, name = log.rows.sparkSession, commits.state(log.rows.sparkSession, path), uuid.uuid4().hex
    if len(now.batches) > 1:
        opened(log, path, now.commit).rows.write.parquet(f"{path}/data/batch={name}")
        commits.committed(spark, path, name, now.top, tuple(now.batches))
    return opened(log, path)


def receipts(log: Log, *parts: Column) -> DataFrame:
    """Each write's seq and the digest of the given parts of its row."""
    return log.rows.select(F.col(log.seq).alias("seq"), receipt(*parts).alias("receipt"))


def chained(log: Log, *parts: Column) -> DataFrame:
    """keys, seq, version and link: a digest over a key's rows up to this one, so a change anywhere shows in all later links.

    A key's rows pass by in order with one digest held; however many there are, none but the current batch is in memory.
    """
    rows = log.rows.select(*log.keys, F.col(log.at).alias("at"), F.col(log.seq).alias("seq"), receipt(*parts).alias("receipt"))
    rows = rows.repartition(*log.keys).sortWithinPartitions(*log.keys, "at", "seq")
    n, names = len(log.keys), [*log.keys, "seq", "version", "link"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, link, version = None, "", 0
        for b in batches:
            links, versions = [], []
            for *now, digest in zip(*(b.column(i).to_pylist() for i in (*range(n), n + 2))):
                if now != key:
                    key, link, version = now, "", 0
                link, version = hashlib.sha256((link + digest).encode()).hexdigest(), version + 1
                links.append(link)
                versions.append(version)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], b.column(n + 1), pa.array(versions, pa.int64()), pa.array(links, pa.string())], names)

    return rows.mapInArrow(run, rows.drop("at", "receipt").schema.add("version", "long").add("link", "string"))


def markdown(turns: DataFrame, key: str = "conv_id", order: str = "turn", heading: str = "role", text: str = "text") -> DataFrame:
    """key and content: an entity's entries as a Markdown page, each under its heading."""
    entry = F.transform(F.array_sort(F.collect_list(F.struct(order, heading, text))), lambda x: F.concat(F.lit("## "), x[heading], F.lit("\n\n"), x[text]))
    return turns.groupBy(key).agg(F.array_join(entry, "\n\n").alias("content"))
