"""The inverted index against scans of all texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from tidemark.operators import index, retrieval
from tidemark.plans.lineage import place

SF = "/root/testdata/sf0.01"


def test_varints_there_and_back():
    draw = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.array([0, 1, 127, 128, 16383, 16384, 2**62]), draw.integers(0, 2**40, 5000), draw.integers(0, 130, 5000)):
        data, ends = index.varints(values)
        assert (index.unvarints(data) == values).all() and len(data) == (ends[-1] if len(ends) else 0)


def odd_units(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choices(words, [1 / (i + 1) for i in range(30)], k=draw.randint(0, 60))) for _ in range(900)]
    texts += [None, "", " ... ", "hot " * 50_000, "W1, w1-W1 w2", "é w1 你好 W2"] + ["hot copy"] * 400
    return spark.createDataFrame([(i if i % 50 else None, t, "kept") for i, t in enumerate(texts)], "id long, text string, number string").withColumn("term", F.lit("x")).drop("number").repartition(7)


@pytest.mark.parametrize("terms", [["w1"], ["w0", "w29"], ["hot", "w3", "hot"], ["none"], ["你好", "w1"]])
def test_search_by_index_is_that_by_scan(spark, terms):
    df = odd_units(spark)
    kept = index.build(df, "text", place(spark, "index"))
    pick = lambda x: sorted(((r.id, r.term, r.score) for r in x.collect()), key=repr)
    want = pick(retrieval.bm25(df, "text", sorted(set(terms))))
    assert pick(index.search(kept, terms)) == want
    got = [r.score for r in index.best(kept, terms, 10, "id").orderBy("rank").collect()]
    assert got == sorted((x[2] for x in want), reverse=True)[:10]


def test_phrases(spark):
    df = odd_units(spark)
    kept = index.build(df, "text", place(spark, "index"))
    for words in (["w0", "w1"], ["w1", "w1", "w1"], ["hot", "hot"], ["w1"], ["w5", "none"]):
        found = sorted((r.times for r in index.phrase(kept, words).collect()), reverse=True)
        want = []
        for r in df.collect():
            tokens = [t for t in "".join(c if c.isalnum() else " " for c in (r.text or "").lower()).split()]
            want.append(sum(tokens[i : i + len(words)] == words for i in range(len(tokens))))
        assert found == sorted((x for x in want if x), reverse=True)


def test_a_task_takes_few_words_and_postings_at_a_time(spark, monkeypatch):
    for name, value in {"WORDS": 500, "RUN": 5, "POSTINGS": 40, "PIECE": 300, "AT_ONCE": 3}.items():
        monkeypatch.setattr(index, name, value)
    taken, varints = spark.sparkContext.accumulator(0), index.varints
    monkeypatch.setattr(index, "varints", lambda values: (taken.add(int(len(values) > 2000)), varints(values))[1])
    df = odd_units(spark).where("length(text) < 100000")
    kept = index.build(df, "text", place(spark, "index"))
    assert taken.value == 0
    want = sorted(((r.id, r.score) for r in retrieval.bm25(df, "text", ["hot", "w1"]).collect()), key=repr)
    assert sorted(((r.id, r.score) for r in index.search(kept, ["hot", "w1"]).collect()), key=repr) == want
    times = [sum(a + b == "w0w1" for a, b in zip(w, w[1:])) for w in ((r.text or "").lower().split() for r in df.collect())]
    assert sorted(r.times for r in index.phrase(kept, ["w0", "w1"]).collect()) == sorted(x for x in times if x)


@pytest.fixture
def large(spark, monkeypatch):
    """How many batches of several rows that go to Python have over a limit of bytes."""
    count, limit, kind = spark.sparkContext.accumulator(0), 400_000, type(spark.range(1))
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: whole(self, lambda bs: f((count.add(int(b.nbytes > limit and len(b) > 1)), b)[1] for b in bs), *a, **k))
    return count


def test_a_batch_has_bounded_bytes_of_long_texts(spark, monkeypatch, large):
    monkeypatch.setattr(index, "BATCH_BYTES", 200_000, raising=False)
    df = spark.range(0, 300, 1, 1).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("w"), (i * F.col("id")) % 997))).alias("text"))
    kept = index.build(df, "text", place(spark, "index"))
    assert large.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    want = sorted((r.id, r.score) for r in retrieval.bm25(df, "text", ["w0", "w7"]).collect())
    assert sorted((r.id, r.score) for r in index.search(kept, ["w0", "w7"]).collect()) == want


def test_a_block_has_bounded_bytes_of_places_of_long_texts(spark):
    df = spark.range(0, 400, 1, 1).select("id", F.concat(F.repeat(F.lit("hot "), 3000), F.lit("w "), F.col("id")).alias("text"))
    kept = index.build(df, "text", place(spark, "index"))
    longest = kept.blocks.agg(F.max(F.octet_length("places")).alias("n"), F.sum(F.when(F.col("term") == "hot", F.col("n"))).alias("units")).first()
    assert longest.n <= 8192 + 3000 and longest.units == 400
    assert sorted((r.id, r.times) for r in index.phrase(kept, ["hot", "hot", "w"]).collect()) == [(i, 1) for i in range(400)]
    assert sorted((r.id, r.times) for r in index.phrase(kept, ["hot", "hot"]).collect()) == [(i, 2999) for i in range(400)]


def test_index_of_nothing(spark):
    kept = index.build(spark.createDataFrame([], "id long, text string"), "text", place(spark, "index"))
    assert index.search(kept, ["a"]).count() == index.best(kept, ["a"], 3, "id").count() == index.phrase(kept, ["a", "b"]).count() == 0


def files_read(df) -> int:
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().apply(0)
    return leaf.metrics().apply("numFiles").value()


def test_a_search_reads_its_own_lists(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    at = place(spark, "index")
    index.build(docs.repartition(16), "text", at)
    kept = index.opened(spark, at)  # from the folder alone
    assert files_read(index.lists(kept, ["that", "hand"]).select("term", "n")) <= files_read(kept.blocks.select("term", "n")) / 8
    plan = index.lists(kept, ["that"]).select("first", "numbers")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,that)" in plan and "places" not in plan.split("ReadSchema")[1]


def test_spans_that_cannot_win_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 50)
    rows = [(i, f"common {'rare' if 2000 <= i < 2010 else 'other'} " + "word " * (i % 40)) for i in range(6000)]
    kept = index.build(spark.createDataFrame(rows, "id long, text string").coalesce(2), "text", place(spark, "index"))
    spans, _ = index.promising(kept, ["common", "rare"], 5)
    assert spans.count() <= 12 < 6000 / 50 / 4
    assert {r.id for r in index.best(kept, ["common", "rare"], 5, "id").collect()} <= set(range(2000, 2010))


@pytest.mark.parametrize("name", ["index_search", "index_top_passages", "index_phrase"])
def test_rows_are_found(spark, name):
    rel = compare.views(SF).sql(__import__("__spark_entry__").oracle_sql()[name])
    assert len(rel.fetchall()) >= 10
