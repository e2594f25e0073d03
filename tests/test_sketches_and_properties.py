"""Sketches against exact counts and ranks, variants against parsed JSON, table functions against the queries that they stand for."""

from __future__ import annotations

import json
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import compare
from tidemark.functions import tables
from tidemark.operators import properties, sketches
from tidemark.plans.lineage import place

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", "usage_reach usage_span usage_quantiles props_paths props_large sql_passages sql_hrefs sql_visits".split())
def test_query_equals_sql(spark, name):
    assert compare.differences(spark, SF, name) == ""


def test_many_ids_are_within_the_stated_error(spark):
    rows = spark.range(400_000).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 10 as int))").alias("at"), (F.col("id") % 150_000).alias("who"), F.col("id").cast("double").alias("v"))
    days = sketches.keep(sketches.daily(rows, "at", "who", "v"), place(spark, "sketches"))
    whole = sketches.span(days, None, None).select("n", F.theta_sketch_estimate("ids").alias("users"), "values").first()
    assert whole.n == 400_000 and abs(whole.users / 150_000 - 1) < 4 / 64
    found = sketches.quantiles(sketches.span(days, None, None).withColumn("one", F.lit(1)), [0.0, 0.001, 0.3, 0.5, 1.0], "one")
    off = sketches.rank_errors(rows.withColumn("one", F.lit(1)), "v", found, "one").collect()
    assert len(off) == 5 and all(r.error <= sketches.RANK_ERROR for r in off)
    # 15 numbers of a residue by 10 each, so no id has two days; the days before share none
    reach = {r.day: (r.users, r.back) for r in sketches.rolling(days, 2).collect()}
    assert len(reach) == 10 and all(abs(u / 30_000 - 1) < 4 / 64 and b == 0 for d, (u, b) in reach.items() if d > date(2024, 1, 1))


@pytest.mark.parametrize("name", ["usage_reach", "usage_span"])
def test_users_are_exact_beyond_a_sketch(spark, tmp_path, name):
    user = F.expr("case when id % 1000 = 7 then null when id < 9000 then id else id % 6000 * 3 end")
    at = F.expr("case when id % 997 <> 3 then timestamp_ntz'2024-01-01' + make_dt_interval(cast(id * 7 % 34 div 2 * 2 as int), cast(id % 24 as int)) end")
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), at.alias("ts"), user.alias("user_id"), F.expr("concat('kind', id % 2)").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert compare.differences(spark, str(tmp_path), name) == ""


def test_ids_of_a_day_that_comes_again_are_replaced(spark):
    at, rows = place(spark, "ids"), spark.read.parquet(f"{SF}/events.parquet")
    sketches.keep_ids(sketches.daily_ids(rows.where("ts < '2024-01-20'"), "ts", "user_id"), at)
    both = sketches.keep_ids(sketches.daily_ids(rows.where("ts >= '2024-01-15'"), "ts", "user_id"), at)
    assert sketches.span_ids(both, None, None).first().n == rows.count()
    none = sketches.keep_ids(sketches.daily_ids(rows.limit(0), "ts", "user_id"), place(spark, "ids"))
    assert sketches.rolling_ids(none, 7).count() == 0


def test_a_day_that_comes_again_is_replaced(spark):
    at, rows = place(spark, "sketches"), spark.read.parquet(f"{SF}/events.parquet")
    first = sketches.keep(sketches.daily(rows.where("ts < '2024-01-20'"), "ts", "user_id", "value"), at)
    early = sketches.span(first, "2024-01-01", "2024-01-10").select("n", F.theta_sketch_estimate("ids")).first()
    both = sketches.keep(sketches.daily(rows.where("ts >= '2024-01-15'"), "ts", "user_id", "value"), at)
    assert sketches.span(both, None, None).first().n == rows.count()
    assert sketches.span(both, "2024-01-01", "2024-01-10").select("n", F.theta_sketch_estimate("ids")).first() == early
    plan = sketches.span(both, "2024-01-01", "2024-01-10")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_sketches_of_nulls_and_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (datetime(2024, 1, 1), None, None), (datetime(2024, 1, 3), 5, 2.0), (datetime(2024, 1, 3), 5, None)], "at timestamp_ntz, who long, v double")
    days = sketches.keep(sketches.daily(rows, "at", "who", "v"), place(spark, "sketches"))
    assert sorted((r.day, r.users, r.back) for r in sketches.rolling(days, 1).collect()) == [(date(2024, 1, 1), 0, 0), (date(2024, 1, 3), 1, 0)]
    assert [r.value for r in sketches.quantiles(sketches.span(days, None, None, "day"), [0.5], "day").collect()] == [2.0]
    none = sketches.keep(sketches.daily(rows.limit(0), "at", "who", "v"), place(spark, "sketches"))
    assert sketches.rolling(none, 7).count() == 0


def plain_paths(values):
    kinds = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", type(None): "VOID"}
    found = Counter()

    def walk(path, x):
        found[path, kinds[type(x)]] += 1
        for k, v in x.items() if isinstance(x, dict) else ((None, v) for v in x) if isinstance(x, list) else ():
            walk(f"{path}[*]" if k is None else f"{path}.{k}", v)

    for v in values:
        walk("$", v)
    return found


def test_paths_of_nested_properties(spark):
    values = [{"k": 1, "tags": ["a", "b", None, {"k": 2.5}]}, {"k": "one", "deep": {"er": {"still": [[True], []]}}}, [], {}, 7, "text", None, {"k": 1, "tags": ["a"]}]
    rows = [json.dumps(v) for v in values] + [None, "", "{not json", json.dumps({"long": "x" * 700_000})]
    kept = properties.parsed(spark.createDataFrame(list(enumerate(rows)), "id long, props string"), "props")
    got = {(r.path, r.kind): r.n for r in properties.paths(kept, "props").collect()}
    assert got == plain_paths([*values, {"long": "x"}])
    fields = properties.fields(kept, "props", ["id"], {"k": ("$.k", "bigint"), "second": ("$.tags[1]", "string")})
    assert {r.id: (r.k, r.second) for r in fields.collect() if r.k or r.second} == {0: (1, "b"), 7: (1, None)}
    assert properties.schema(kept.where("id in (0, 7)"), "props").startswith("OBJECT<k: BIGINT")
    assert properties.paths(kept.limit(0), "props").count() == 0


def test_table_functions_of_odd_rows(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "a\n\nb", "x"), (1, "a\n\nb", "x"), (2, None, None), (None, "", "y"), (3, "\n" * 600_000 + "end", "z")], "id long, body string, other string")
    got = spark.sql("select * from passages(table(select * from {docs}), 'body')", docs=docs).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "x", 0, "a"), (1, "x", 2, "b")] * 2 + [(3, "z", 600_000, "end")])
    pages = spark.createDataFrame([(1, """<a href='x?a=1&amp;b=&#38;'>1</a><!-- <a href="no"> --><A class=c HREF=/y>"""), (2, None)], "id long, html string")
    got = spark.sql("select id, pos, href from hrefs(table(select * from {pages}), 'html')", pages=pages).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "x?a=1&b=&"), (1, 1, "/y")]
    for wrong, message in (("'none'", "has no column"), ("'other'", "has a column pos")):
        with pytest.raises(AnalysisException, match=message):
            spark.sql(f"select * from passages(table(select *, 1 as pos from {{docs}}), {wrong})", docs=docs)


def test_visits_of_a_hot_key(spark):
    tables.register(spark)
    start = datetime(2024, 1, 1)
    rows = [("hot", start + timedelta(minutes=i * 7 + (i // 50) * 40)) for i in range(3000)] + [("hot", start)] * 2 + [("b", None), (None, start), (None, start + timedelta(minutes=30))]
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz")
    got = spark.sql("select * from visits(table(select * from {df}) partition by key order by (at), 'key', 'at', 30)", df=df).collect()
    want = {}
    for k in ("hot", None):
        for t in sorted(t for key, t in rows if key == k and t):
            runs = want.setdefault(k, [])
            if runs and t - runs[-1][1] < timedelta(minutes=30):
                runs[-1][1:] = [t, runs[-1][2] + 1]
            else:
                runs.append([t, t, 1])
    assert Counter(map(tuple, got)) == Counter((k, *r) for k, runs in want.items() for r in runs) and len(want["hot"]) == 60
