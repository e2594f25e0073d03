"""Small tables with all that can go wrong: nulls, empty and long texts, ties, repeated rows, names that clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import compare

LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(1_500))
PROSE = "the quick brown fox jumps over the lazy dog and then it walks home through the quiet green wood while rain falls on all the leaves of spring"
ITEM = "a river of small stones runs along the old wall behind our house and nobody knows how long it has been there"
DOCS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, "One", "en", "b"),
    (5, "one", "de", "b"),
    (6, PROSE, "en", "a"),
    (7, PROSE.upper(), "en", "c"),
    (8, PROSE + " again", "en", "a"),
    (8, PROSE + " again", "en", "a"),
    (9, LONG, "en", "a"),
    (10, LONG + " end", "en", None),
    (11, f"before it {ITEM} and after it", "en", "b"),
    (11, "same id, other text", "en", "b"),
    (12, ITEM, "en", "a"),
    (13, f"{PROSE} {ITEM} {PROSE}", "en", "z"),
    (14, "x\nx\nx\ny y y y y\n\n# $ % & | < > *", "en", "\U0001f600"),
    (15, "Füße und ß — naïve “quotes” 你好 世界   tab\u000bvt", "de", ""),
    (16, " ".join(["spam ham eggs"] * 40), "en", "a"),
    (None, "no id here but some words", None, "a"),
    (None, None, None, None),
]
ITEMS = [(1, ITEM), (2, None), (3, ""), (4, "one"), (5, ITEM), (5, ITEM), (6, "three short words"), (None, "spam ham eggs spam ham eggs spam ham")]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark: SparkSession, rows: list[tuple] | None = None, clash: tuple[str, ...] = ()) -> DataFrame:
    """The rows with n_chars, and with string columns of the names in clash."""
    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA).selectExpr("*", "length(text) as n_chars")
    for c in clash:
        df = df.selectExpr("*", f"'kept' as `{c}`")
    return df


def benchmark(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")


def tables(at: str, **frames: DataFrame) -> str:
    """Writes frames as the tables of a folder that queries and SQL can be run on."""
    for name, df in frames.items():
        df.coalesce(2).write.parquet(f"{at}/{name}.parquet")
    return at


def sql_rows(at: str, sql: str) -> list[tuple]:
    rel = compare.views(at).sql(sql)
    return compare.rows(rel.columns, rel.fetchall())


def spark_rows(df: DataFrame) -> list[tuple]:
    return compare.rows(df.columns, df.collect())
