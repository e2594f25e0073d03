"""Vector search: exact against all pairs, and how much of it the cells find."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vectors
from tidemark.plans import reference


def clouds(n=1500, dims=8, groups=20):
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(groups, dims))
    return [(i, (middles[i % groups] + 0.15 * draw.normal(size=dims)).tolist()) for i in range(n)]


ODD = [(-100, None), (-200, [1.0]), (-300, [0.0] * 8), (-400, [math.nan] * 8), (-500, [None] * 8), (-600, [math.inf] * 8), (-700, [1e300] * 8)]


def brute(rows, k=None, least=None):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    ids, m = list(unit), np.array(list(unit.values()))
    out = {}
    for q in ids:
        if q % 100 == 0:
            cosines = np.round(m @ unit[q], 6)
            order = sorted((-c, i) for c, i in zip(cosines, ids) if i != q)
            out[q] = [(i, -c) for c, i in order[:k] if least is None or -c >= least]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_exact_and_within_are_those_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(vectors, "BLOCK", 70)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    rows = clouds() + [(10_000 + i, [1.0, 0.001 * i, *[0.0] * 6]) for i in range(700 if hot else 0)]  # a third in one place
    df = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<double>").withColumn("cell", F.lit("mine")).repartition(4)
    cells = vectors.fitted(df, dims=8, cells=16)
    for got, want in ((vectors.nearest(cells, "id % 100 = 0", 5), brute(rows, 5)), (vectors.within(cells, "id % 100 = 0", 0.9), brute(rows, least=0.9))):
        found = {}
        for r in got.orderBy("query_id", F.col("cosine").desc(), "vec_id").collect():
            found.setdefault(r.query_id, []).append((r.vec_id, r.cosine))
        assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    asked = vectors._probes(cells.rows.where("id % 100 = 0"), cells, None, math.acos(0.9)).count()
    assert asked < 16 * len(brute(rows)) / 2  # most cells can't have any


def test_cells_find_most(spark):
    df = spark.createDataFrame(clouds(), "vec_id long, embedding array<double>")
    cells = vectors.fitted(df, dims=8, cells=32)
    probe = vectors.probes(cells)
    exact = vectors.nearest(cells, "id % 100 = 0")
    assert probe < 12 and vectors.recall(vectors.nearest(cells, "id % 100 = 0", probe=probe), exact).first()[0] >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_search_finds_most_of_the_embeddings(spark, sf):
    d = f"/root/testdata/{sf}"
    assert vectors.recall(reference.vector_search(spark, d), reference.vector_exact(spark, d)).first()[0] >= 0.9


def test_vectors_of_nothing(spark):
    for rows in ([], ODD):
        cells = vectors.fitted(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=8)
        assert vectors.nearest(cells, "id % 100 = 0").count() == vectors.within(cells, "true", 0.1).count() == 0 and vectors.probes(cells) == 0
    one = vectors.fitted(spark.createDataFrame([(100, [1.0, 0.0])], "vec_id long, embedding array<double>"), dims=2)
    assert vectors.nearest(one, "id % 100 = 0").count() == 0
