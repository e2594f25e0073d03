"""The shared folder, and cutting the lineage of iterative queries there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where none is set, as in tests, a local one that is set for the session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Paths that were given out within the innermost ``passing``.
_given: ContextVar[list[str] | None] = ContextVar("given", default=None)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if (given := _given.get()) is not None:
        given.append(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that what uses it more than once reads it and doesn't make it anew."""
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after an error, what the steps within it wrote to places of the shared folder.

    A query is computed from such tables when its rows are made, so what is to last has to be written within, to a place from outside.
    """
    given: list[str] = []
    token = _given.set(given)
    try:
        yield
    finally:
        _given.reset(token)
        for at in given:
            removed(spark, at)


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
