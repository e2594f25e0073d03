"""Streams with state that outlive their process, late rows and sessions."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

import compare
from tidemark.plans import reference
from tidemark.plans.lineage import place
from tidemark.streaming import monitors, watch

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CHILD = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tidemark.streaming import watch
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
stream = spark.readStream.schema(spark.read.parquet(sys.argv[2]).schema).option("maxFilesPerTrigger", 1).parquet(sys.argv[2])
watch.started(watch.watched(stream, ["user_id", "event_type"], "ts", "event_id", F.col("props"), "400 days"), sys.argv[3]).awaitTermination()
"""


def in_files(spark, tmp_path, n=8):
    df = spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(1, "event_id")
    for i in range(n):  # in the order of their times
        df.where((F.col("event_id") >= i * 1000 // n) & (F.col("event_id") < (i + 1) * 1000 // n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def expected(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    return sorted((r.event_id, r.user_id, r.event_type, r.found) for r in monitors.changes(df, ["user_id", "event_type"], "ts", "event_id", F.col("props")).collect())


def stream_of(spark, at, per_batch=1):
    return spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", per_batch).parquet(at)


def looked(spark, at, done):
    got = watch.ran(watch.watched(stream_of(spark, at), ["user_id", "event_type"], "ts", "event_id", F.col("props"), "400 days"), done)
    return sorted((r.seq, r.user_id, r.event_type, r.found) for r in got.collect())


def test_a_killed_monitor_goes_on(spark, tmp_path):
    at, done = in_files(spark, tmp_path), f"file://{tmp_path}/done"
    (tmp_path / "child.py").write_text(CHILD)
    child = subprocess.Popen([sys.executable, str(tmp_path / "child.py"), ROOT, at, done], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    commits = tmp_path / "done" / "checkpoint" / "commits"
    until = time.time() + 90
    while time.time() < until and child.poll() is None and not (commits.is_dir() and (commits / "1").exists()):
        time.sleep(0.05)
    os.killpg(child.pid, signal.SIGKILL)
    child.wait()
    batches = len([x for x in os.listdir(commits) if x.isdigit()])
    assert 2 <= batches < 8  # it was in the middle
    assert looked(spark, at, done) == expected(spark)
    assert looked(spark, at, done) == expected(spark)  # nothing new, nothing twice


def test_a_stopped_monitor_goes_on(spark, tmp_path):
    at, done = in_files(spark, tmp_path, 5), place(spark, "watch")
    query = watch.started(watch.watched(stream_of(spark, at), ["user_id", "event_type"], "ts", "event_id", F.col("props"), "400 days"), done)
    while query.isActive and len(query.recentProgress) < 2:
        time.sleep(0.05)
    query.stop()
    assert looked(spark, at, done) == expected(spark)


def test_state_ends_by_a_timer(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00", "x"), ("b", 2, "2024-01-01 01:00:00", None), ("a", 3, "2024-01-01 02:00:00", "y"), ("c", 4, "2024-01-04 00:00:00", "z"), ("a", 5, "2024-01-04 00:00:00.5", "y"), ("d", 6, "2024-01-20 00:00:00", "")]
    df = spark.createDataFrame(rows, "key string, seq long, at string, content string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    for i in range(3):
        df.where(f"seq > {2 * i} and seq <= {2 * i + 2}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for per_batch in (1, 9):
        got = watch.ran(watch.watched(stream_of(spark, str(tmp_path / "in"), per_batch), ["key"], "at", "seq", F.col("content"), "1 day"), place(spark, "watch"))
        found = sorted((r.key, str(r.at), r.found) for r in got.collect())
        assert found == [
            ("a", "2024-01-01 00:00:00", "new"), ("a", "2024-01-01 02:00:00", "changed"), ("a", "2024-01-02 02:00:00", "gone"), ("a", "2024-01-04 00:00:00.500000", "new"), ("a", "2024-01-05 00:00:00.500000", "gone"),
            ("b", "2024-01-01 01:00:00", "new"), ("b", "2024-01-02 01:00:00", "gone"), ("c", "2024-01-04 00:00:00", "new"), ("c", "2024-01-05 00:00:00", "gone"), ("d", "2024-01-20 00:00:00", "new"),
        ]


def test_late_rows_are_kept_apart_and_sessions_close(spark):
    con = compare.views(SF)
    late = reference.stream_late(spark, SF).where("late").count()
    sessions = reference.stream_sessions(spark, SF)
    n = sessions.agg(F.sum("n")).first()[0]
    assert 0 < late < 500 and 0 < n <= 1000 - late
    assert late == con.sql(f"select count(*) from ({reference.SQL['stream_late']}) where late").fetchall()[0][0]


def test_a_stream_without_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(str(tmp_path / "in"))
    assert looked(spark, str(tmp_path / "in"), place(spark, "watch")) == []


@pytest.mark.parametrize("name", ["stream_watch", "stream_sessions"])
def test_streams_leave_their_state_in_the_shared_folder(spark, name):
    rows = getattr(reference, name)(spark, SF)
    assert rows.count() and all("/rows/part-" in x for x in rows.inputFiles())


class Handle:
    """State and timers of one key; counts how often it is asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _ask(self, value=None):
        self.asked += 1
        return value

    def exists(self):
        return self._ask(self.value is not None)

    def get(self):
        return self._ask(self.value)

    def update(self, value):
        self.value = self._ask(value)

    def clear(self):
        self.value = self._ask()

    def registerTimer(self, at):
        self._ask(self.timers.add(at))

    def deleteTimer(self, at):
        self._ask(self.timers.remove(at))


def looks_of(quiet, handle, *rows):
    looks = watch.Looks(["key"], quiet)
    looks.init(handle)
    return looks, [(r.key, r.seq, r.at, r.found) for r in looks.handleInputRows(("a",), (Row(key="a", seq=s, at=at, digest=d) for s, at, d in rows), None)]


def test_a_batch_asks_little_of_the_state():
    handle = Handle()
    assert looks_of(5000, handle, (3, 3000, "y"), (None, 3000, "y"), (1, 1000, "x"), (4, 9000, "y"))[1] == [
        ("a", 1, 1000, "new"), ("a", 3, 3000, "changed"), ("a", None, 3000, "same"), ("a", None, 8000, "gone"), ("a", 4, 9000, "new"),
    ]
    assert handle.asked == 3 and handle.timers == {14}
    assert looks_of(5000, handle, (5, 9001, "y"))[1] == [("a", 5, 9001, "same")]
    assert handle.asked == 8 and handle.timers == {15}


def test_a_timer_of_a_shorter_quiet_ends_no_key_too_early():
    handle = Handle()
    looks_of(5000, handle, (1, 1000, "x"))
    longer = watch.Looks(["key"], 9000)
    longer.init(handle)
    assert list(longer.handleExpiredTimer(("a",), None, ExpiredTimerInfo(6))) == [] and handle.value and 10 in handle.timers
    assert [(r.seq, r.at, r.found) for r in longer.handleExpiredTimer(("a",), None, ExpiredTimerInfo(10))] == [(None, 10000, "gone")]
    assert list(longer.handleExpiredTimer(("a",), None, ExpiredTimerInfo(11))) == []


def test_deliveries_are_not_dealt_to_a_task_each(spark, monkeypatch):
    plans = []

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(reference, "stored", stored)
    reference.arrived(spark, SF, lambda stream: None)
    assert len(plans) == 1 and "Exchange" not in plans[0]
