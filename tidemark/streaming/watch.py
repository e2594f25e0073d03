"""Monitors that outlive a restart: what a stream knows of each key is in Spark's state store, its results in a folder, and both in a place that the caller names.

A stream that is stopped, or whose driver or executors are lost, goes on from its checkpoint when it is started again over the same place, and its results hold every
row once. State ends: a key's by a timer, windows and sessions by the watermark. Rows that come too late for these are kept apart, not lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: State is in RocksDB; Spark doesn't count its rows, as it would look up each key once more for that.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


class Looks(StatefulProcessor):
    """Of each key the digest and the time of the last look; a timer ends it when there was no look for quiet microseconds.

    Takes and gives rows, not pandas frames, and asks the state as little as it can: most keys have few looks in a batch, so what is done once a key is what a batch costs.
    """

    def __init__(self, keys: list[str], quiet: int):
        self.row, self.quiet = Row(*keys, "seq", "at", "found"), quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "digest string, at long")

    def _due(self, at: int) -> int:
        """When the timer of a key that was last looked at then goes off, in milliseconds."""
        return -(-(at + self.quiet) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(((r["at"], r["seq"] is None, r["seq"], r["digest"]) for r in rows), key=lambda x: (x[0], x[1], x[2] or 0))  # a key's rows of one batch
        digest, at = self.last.get() if self.last.exists() else (None, None)
        timer = None if at is None else self._due(at)
        found = []
        for now, _, seq, new in batch:
            if at is not None and now - at > self.quiet:
                found.append(self.row(*key, None, at + self.quiet, "gone"))
                digest = None
            found.append(self.row(*key, seq, now, "new" if digest is None else "same" if digest == new else "changed"))
            digest, at = new, now
        if timer != self._due(at):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._due(at))
        self.last.update((digest, at))
        yield from found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()
        if last is None:
            return
        at = last[1]
        if expiredTimerInfo.getExpiryTimeInMs() < self._due(at):  # left from a shorter quiet, before a restart
            self.handle.registerTimer(self._due(at))
            return
        self.last.clear()
        yield self.row(*key, None, at + self.quiet, "gone")

    def close(self) -> None:
        pass


def watched(looks: DataFrame, key: list[str], at: str, seq: str, content: Column, quiet: str = "2 days", late: str = "1 hour") -> DataFrame:
    """Of a stream of looks: key, seq, at and found, a row for each look (new, changed or same) and one when a key has not been looked at for quiet (gone, without seq).

    After that a look is new again. Looks have to come in order of time but for late; rows that are later are left out. Null content is content like any other. A key's rows of one
    batch are in memory together, so a batch's size (maxBytesPerTrigger, maxFilesPerTrigger) bounds them.
    """
    spark = looks.sparkSession
    micros = int(spark.sql(f"select unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {quiet}) as m").first().m)
    digest = F.coalesce(F.sha2(content, 256), F.lit(""))
    time = F.col(at).cast("timestamp")
    rows = looks.select(*key, F.col(seq).cast("long").alias("seq"), F.unix_micros(time).alias("at"), digest.alias("digest"), time.alias("event_time")).withWatermark("event_time", late)
    schema = T.StructType([*(rows.schema[k] for k in key), *T.StructType.fromDDL("seq long, at long, found string").fields])
    found = rows.groupBy(*key).transformWithState(Looks(key, micros), schema, "append", "eventTime")
    return found.select(*key, "seq", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "found")


def started(stream: DataFrame, place: str, **options: str) -> StreamingQuery:
    """Starts a stream that appends to place/rows and keeps its offsets and state in place/checkpoint, until it has read all there is. Over a place in use it goes on from there."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        conf.set(k, v)
    try:
        return stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").options(**options).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v) if v else conf.unset(k)


def results(spark: SparkSession, place: str, schema: T.StructType) -> DataFrame:
    """What has been appended to place so far."""
    try:
        return spark.read.schema(schema).parquet(f"{place}/rows")
    except AnalysisException:  # nothing has been written
        return spark.createDataFrame([], schema)


def ran(stream: DataFrame, place: str) -> DataFrame:
    """The results of a stream over place once it has read all there is."""
    started(stream, place).awaitTermination()
    return results(stream.sparkSession, place, stream.schema)


def split(stream: DataFrame, at: str, late: str, place: str) -> tuple[str, str]:
    """Reads all there is of a stream of rows into place/on_time and place/late; these two folders.

    A row is late if its time is before the latest time of all batches before its own, less late. Each batch writes folders of its own, anew if it is run again, and the latest time it has
    seen, so a stream that is stopped goes on with the same split.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        try:
            seen = own.read.schema("latest timestamp_ntz, batch long").parquet(f"{place}/seen").where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        except AnalysisException:
            seen = None
        before = F.lit(seen).cast("timestamp_ntz") - F.expr(f"interval {late}")
        is_late = F.coalesce(F.col(at) < before, F.lit(False))
        for name, rows in (("on_time", batch.where(~is_late)), ("late", batch.where(is_late)), ("seen", batch.agg(F.max(at).cast("timestamp_ntz").alias("latest")))):
            rows.write.mode("overwrite").parquet(f"{place}/{name}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{place}/on_time", f"{place}/late"


def sessions(rows: DataFrame, key: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Of a stream of rows: key, first_at, last_at, closed_at (gap after the last) and n of each session once it is over; late bounds how long one is kept open."""
    stamped = rows.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    found = stamped.groupBy(*key, F.session_window("event_time", gap).alias("s")).agg(F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return found.select(*key, *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_at", "last_at")), F.col("s.end").cast("timestamp_ntz").alias("closed_at"), "n")
