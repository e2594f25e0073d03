"""Joins by time and proofs of the log, against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, proofs

START = datetime(2024, 1, 1)


def moments(draw, n, keys):
    return [(draw.choice(keys), None if draw.random() < 0.02 else START + timedelta(hours=draw.randint(0, 24 * 40))) for _ in range(n)]


@pytest.mark.parametrize("bin", ["1 hour", "3 days", "400 days"])
def test_as_of_is_the_last_before(spark, bin):
    draw = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    rows = [(i, k, t) for i, (k, t) in enumerate(moments(draw, 900, keys))]
    rows += rows[:20]
    versions = [(k, t, i, None if i % 9 == 0 else f"v{i}") for i, (k, t) in enumerate(moments(draw, 500, keys[:-2] + ["only here", None]))]
    left = spark.createDataFrame(rows, "id long, key string, at timestamp_ntz")
    right = spark.createDataFrame(versions, "key string, since timestamp_ntz, n long, v string")
    want = Counter()
    for i, k, t in rows:
        held = [(since, n, v) for key, since, n, v in versions if k is not None and key == k and t is not None and since is not None and since <= t]
        best = max(held, key=lambda x: x[:2], default=(None, None, None))
        want[i, k, t, best[1], best[2], best[0]] += 1
    got = asof.as_of(left, right, ["key"], "at", "since", ["n", "v"], ("n",), bin)
    assert Counter(map(tuple, got.select("id", "key", "at", "n", "v", "since").collect())) == want
    assert asof.as_of(left, right.limit(0), ["key"], "at", "since", ["v"]).where("v is not null").count() == asof.as_of(left.limit(0), right, ["key"], "at", "since", ["v"]).count() == 0


@pytest.mark.parametrize("bin", ["1 hour", "3 days", "400 days"])
def test_spans_hold_their_moments(spark, bin):
    draw = random.Random(4)
    keys = ["hot"] * 5 + ["a", "b", None]
    rows = [(i, k, t) for i, (k, t) in enumerate(moments(draw, 300, keys))]
    spans = [(i, k, t, t + timedelta(hours=draw.choice([-5, 0, 1, 30, 300])) if t else None) for i, (k, t) in enumerate(moments(draw, 200, keys))]
    want = Counter((i, j) for i, k, t in rows for j, key, a, b in spans if k is not None and k == key and t and a and a <= t < b)
    got = asof.spans_at(spark.createDataFrame(rows, "id long, key string, at timestamp_ntz"), spark.createDataFrame(spans, "span long, key string, a timestamp_ntz, b timestamp_ntz"), ["key"], "at", "a", "b", bin)
    assert Counter((r.id, r.span) for r in got.collect()) == want


def plain_root(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1
    while 2 * k < len(leaves):
        k *= 2
    return hashlib.sha256(b"\1" + plain_root(leaves[:k]) + plain_root(leaves[k:])).digest()


def test_every_write_is_proven_and_no_other(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 7, "e": 64, "f": 65, "g": 301}
    rows = [(b, i, f"receipt {b} {i}") for b, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "batch string, seq long, receipt string").repartition(5)
    nodes = proofs.tree(df, "batch", ["seq"])
    roots = {r.batch: (r.root, r.size) for r in proofs.roots(nodes).collect()}
    assert roots == {b: (plain_root([hashlib.sha256(b"\0" + f"receipt {b} {i}".encode()).digest() for i in range(n)]).hex(), n) for b, n in sizes.items()}
    found = proofs.proofs(nodes, df.select("batch", F.col("seq").alias("place")))
    checked = found.join(df.withColumnRenamed("seq", "place"), ["batch", "place"])
    right = {(r.batch, r.place): r.root for r in checked.select("batch", "place", proofs.proven(proofs.leaf_of(F.col("receipt")), F.col("path")).alias("root")).collect()}
    assert len(right) == len(rows) and all(right[b, i] == roots[b][0] for b, i, _ in rows)
    changed = checked.select("batch", proofs.proven(proofs.leaf_of(F.concat("receipt", F.lit("!"))), F.col("path")).alias("root")).collect()
    assert all(r.root != roots[r.batch][0] for r in changed)
    moved = checked.select("batch", proofs.proven(F.col("digest"), F.reverse("path")).alias("root"), F.size("path").alias("n")).where("n > 2").collect()
    assert all(r.root != roots[r.batch][0] for r in moved)


def test_a_changed_write_changes_its_root(spark):
    rows = [("a", i, str(i)) for i in range(50)]
    root = lambda rows: proofs.roots(proofs.tree(spark.createDataFrame(rows, "batch string, seq long, receipt string"), "batch", ["seq"])).first().root
    assert root(rows) != root([*rows[:30], ("a", 30, "other"), *rows[31:]]) and root(rows) == root(rows[::-1])
    assert proofs.tree(spark.createDataFrame([], "batch string, seq long, receipt string"), "batch", ["seq"]).count() == 0


def test_a_log_that_has_grown_is_consistent():
    roots = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20)]
    for new in range(1, 21):
        for old in range(1, new + 1):
            a, b, proof = proofs.log_root(roots[:old]), proofs.log_root(roots[:new]), proofs.consistency(roots[:new], old)
            assert proofs.consistent(a, old, b, new, proof) and len(proof) <= 6
            other = proofs.log_root([*roots[: old - 1], "00" * 32])
            assert not proofs.consistent(other, old, b, new, proof) and not proofs.consistent(a, old, other, new, proof)
            if proof:
                assert not proofs.consistent(a, old, b, new, proof[:-1])
