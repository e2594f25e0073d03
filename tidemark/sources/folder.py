"""A folder of Markdown pages, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_markdown(pages: DataFrame, path: str, key: str = "conv_id", content: str = "content") -> None:
    """One folder key=... with a text file for each page."""
    pages.select(key, content).write.mode("overwrite").partitionBy(key).text(path)


def read_markdown(spark: SparkSession, path: str, key: str = "conv_id") -> DataFrame:
    """key and content of each page, whole files at a time."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col(key), F.regexp_replace("value", r"\n\z", "").alias("content"))
