from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alike, retrieval

SCHEMA = "doc_id long, rank long, text string"


def of_all_pairs(texts: list[str | None], percent: int) -> list[int]:
    """Places of those without a better one (an earlier one) of nearly the same words."""
    sets = [set((t or "").split()) for t in texts]
    return [i for i, s in enumerate(sets) if not any(100 * len(s & o) >= percent * len(s | o) for o in sets[:i])]


def some_texts(seed: int) -> list[str | None]:
    """Texts of 0 to 400 words, rare and frequent ones, with copies, near copies and a large group of near copies."""
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.6))}" for _ in range(4000)]
    texts = [draw.sample(words, draw.choice((1, 2, 3, 7, 20, 60, 150, 400))) for _ in range(80)]
    for t in texts[:]:
        texts.append([w for w in t if draw.random() > draw.choice((0.02, 0.14, 0.25, 0.3))] + draw.sample(words, len(t) // draw.choice((8, 20, 1000))))
    base = draw.sample(words, 40)
    texts += [[*base[: draw.randint(30, 40)], f"own{i}"] for i in range(60)]
    found = [" ".join(t) for t in texts] + ["", None, *(" ".join(t[::-1]) for t in texts[:20])]
    draw.shuffle(found)
    return found


def written(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_small_groups_and_steps_give_the_results_of_all_pairs(spark, monkeypatch, percent):
    for name, value in (("WORDS", 500), ("GROUP", 300), ("MEETS", 7), ("FREQUENT", 40)):
        monkeypatch.setattr(alike, name, value)
    texts = some_texts(percent)
    df = spark.createDataFrame([(i, i + 1, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in retrieval.merged(df, "doc_id", "text", percent).collect()) == of_all_pairs(texts, percent)


def test_large_sets_that_meet_are_not_shuffled(spark):
    draw = random.Random(3)
    words = [f"word{i}" for i in range(1800)]
    texts = [" ".join(draw.sample(words, 900)) for _ in range(300)]
    df = spark.createDataFrame([(i, i + 1, t) for i, t in enumerate(texts)], SCHEMA)
    before = written(spark)
    assert retrieval.merged(df, "doc_id", "text").count() == 300
    assert written(spark) - before < sum(map(len, texts))


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(alike, "hashed", lambda word, seed: F.xxhash64(F.substring(word, 1, 1) if seed == 42 else word, F.lit(seed)))
    df = spark.createDataFrame([(1, 1, "aa b c d"), (2, 2, "ab b c d"), (3, 3, "b c d aa")], SCHEMA)
    assert sorted(r.doc_id for r in retrieval.merged(df, "doc_id", "text").collect()) == [1, 2]


def test_texts_beside_the_results_and_ids_of_two_texts(spark):
    texts = [(1, "a b c d"), (1, "e f g h"), (2, "d c b a"), (3, "x y"), (4, "not a result"), (5, "e f g h i"), (None, "x y")]
    ranks = [(1, 1), (1, 2), (2, 3), (3, 4), (5, 5), (6, 6)]
    got = retrieval.merged(spark.createDataFrame(ranks, "doc_id long, rank long"), "doc_id", "text", texts=spark.createDataFrame(texts, "doc_id long, text string"))
    assert got.columns == ["doc_id", "rank"] and sorted(map(tuple, got.collect())) == [(1, 1), (1, 1), (3, 4)]


def test_no_results(spark):
    assert retrieval.merged(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_texts_that_have_a_term_are_those_with_a_score(spark):
    texts = ["that", "THAT hand", "xthat", "thatx", "that1", "éthat", "a-that_b", "that\n", "\nthat", "x\nthat\ny", "hand.", "", None, "other", "tha", "that́"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = {r.doc_id for r in retrieval.bm25(df, "text", ["that", "hand"]).collect()}
    assert {r.doc_id for r in retrieval.having(df, "text", ["that", "hand"]).collect()} == scored == {0, 1, 6, 7, 8, 9, 10}
