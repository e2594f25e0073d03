"""Conversation repair, exact top-k search and centroid clustering, against plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import odd
from tidemark.llm import centroids, repair, topk

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cost, audit and repaired rows by the cheapest and then least audit to each state, a row at a time."""
    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(best):
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                to, new = (3 if s == 2 else 2), (cost + 3, audit + "I")
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    best = closed({0: (0, "")})
    for (_, role, _), fault in zip(rows, faults(rows)):
        new = {}

        def put(s, cost, audit):
            if s not in new or (cost, audit) < new[s]:
                new[s] = (cost, audit)

        for s, (cost, audit) in best.items():
            put(s, cost + 4, audit + "D")
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                put(3 if s == 2 else 2, cost + 3 + more, audit + "R")
                if (s, role[:1]) in move:
                    put(move[s, role[:1]], cost + more, audit + "K")
        best = closed(new)
    cost, audit = min(best[s] for s in (0, 3) if s in best)
    out, at, state = [], 0, 0
    for letter in audit:
        row = None
        if letter != "I":
            row, at = rows[at], at + 1
        if letter == "D":
            continue
        state = move[state, row[1][:1]] if letter == "K" else 3 if state == 2 else 2
        out.append((row[1] if letter == "K" else ("", "", "user", "assistant")[state], row[2] if row else ""))
    return cost, audit, out


def plain_report(rows):
    """rows (conv_id, turn, role, text) -> what reports() gives, and the repaired rows."""
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append((row[0], row[1] if row[1] is not None else " ", row[2] if row[2] is not None else " "))
    report, texts = set(), set()
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        count = Counter(faults(found))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        turns = [t for t, *_ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, out = plain_repair(found)
        whole = "\n".join(f"{r}:{t}" for r, t in out)
        report.add((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
        texts |= {(conv, i, *row) for i, row in enumerate(out)}
    return report, texts


def odd_turns():
    draw = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "Ünser"], ["Yes.", "no", "What?", " \t", "", None, "Fine!\n", "a" * 100 + ".", "a" * 100, "ends . ", "é.", "one.", "two.", "three."]
    rows = [(c, draw.choice([None, *range(n + 2)]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.6 else f"{draw.random()}.") for c in range(60) for n in [draw.randint(0, 9)] for _ in range(n)]
    rows += [(77, i // 2, draw.choice(roles), draw.choice(texts) if i % 3 else f"{i}.") for i in range(700)]  # most of the rows
    rows += [(78, i, "user", "again and again") for i in range(200)] + [(79, i, "uasu"[i % 4 : i % 4 + 1] or "a", f"{i}.") for i in range(130)]
    return rows + [(None, None, None, None), (None, 3, "assistant", "hello."), (80, None, "assistant", "long " * 200_000 + "."), (80, None, "user", "x")]


@pytest.mark.parametrize("size", [1, 5, 64])
def test_repair_is_the_least(spark, size):
    rows = odd_turns()
    report, texts = plain_report(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({"audit": F.lit("mine"), "number": F.lit(1), "kind": F.lit(1)})
    assert set(map(tuple, repair.reports(df, size=size).collect())) == report
    assert set(map(tuple, repair.repaired(df, size=size).collect())) == texts


def test_repair_query_on_odd_rows_equals_sql(spark, tmp_path):
    rows = [(c, t, r, f"{x}{i}" if x else x) for i, (c, t, r, x) in enumerate(odd_turns()) if x is None or len(x) < 1000]
    rows = [(c, i if t is not None else None, r, x) for i, (c, t, r, x) in enumerate(rows)]  # turns without ties
    rows = [r for i, r in enumerate(rows) if r[1] is not None or (i % 7 == 0 and r[0] is not None and r[0] > 70) or r[0] is None]
    at = odd.tables(str(tmp_path), conversations=spark.createDataFrame(rows, TURNS))
    assert odd.spark_rows(repair.op11_repair(spark, at)) == odd.sql_rows(at, repair.OP11_SQL)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.reports(none).count() == 0
    got = repair.reports(none, spark.createDataFrame([(4, 1, "user", "x")], TURNS)).collect()
    assert [tuple(r) for r in got] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def odd_vectors(width=8):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=width).tolist()) for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(200, 320)]  # a large group of equal vectors
    rows += [(i, [0.0] * width) for i in range(320, 370)] + [(40, rows[40][1]), (40, rows[41][1]), (60, None), (61, [])]
    rows += [(80, [1.0] * (width - 1) + [math.nan]), (81, [1.0] * (width - 1) + [math.inf]), (100, [1.0] * (width - 1) + [None]), (120, [2.0] * (width - 3)), (140, [1e5] + [0.5] * (width - 1)), (160, [1e12] * width)]
    return rows + [(None, rows[3][1]), (None, rows[3][1]), (-20, rows[5][1])]


def plain_top(rows, k, scale=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) and abs(x * scale) < topk.MOST for x in v):
            kept.append((vec_id, [math.floor(x * scale) for x in map(float, v)]))
    out = []
    for i, (q, a) in enumerate(kept):
        if q is not None and q % 20 == 0:
            found = [(-sum(x * y for x, y in zip(a, b)), c is None, c or 0, c) for j, (c, b) in enumerate(kept) if j != i]
            out += [(q, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return Counter(out)


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_top_k_is_that_of_all_pairs(spark, monkeypatch, bits):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"rank": F.lit("mine"), "score": F.lit(0), "place": F.lit(0)})
    got = topk.top(df, "vec_id % 20 = 0", k=5, bits=bits)
    assert Counter(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain_top(rows, 5)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top(spark.createDataFrame([], schema), "vec_id % 20 = 0").count() == 0
    assert topk.top(spark.createDataFrame([(20, None), (1, [1.0])], schema), "vec_id % 20 = 0").count() == 0
    assert topk.top(spark.createDataFrame([(20, [1.0])], schema), "vec_id % 20 = 0").count() == 0
    got = topk.top(spark.createDataFrame([(20, [1.0, 0.5]), (3, [1.0]), (2, [0.5, 1.0]), (1, [0.5, 1.0])], schema), "vec_id % 20 = 0")
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 4096), (2, 4096), (3, 4096)]


def test_bounds_hold_and_cells_are_narrow():
    draw = np.random.default_rng(1)
    v = np.floor(draw.normal(size=(500, 6)) * 50).astype(int)
    v[3] = 10**6
    grid = topk.Grid.over([(int(c.min()), int(c.max()), float(np.median(c)), 50.0) for c in v.T], 4)
    low, high = grid.ends(grid.cells(v))
    assert (low <= v).all() and (v <= high).all() and np.median(high - low) < 30
    lower, upper = topk.bounds(v[:20], low, high)
    exact = v[:20] @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()


def plain_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(256 * x) < centroids.MOST for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    c = [v for i, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        at = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, a) in zip(kept, at) if a == j]
                c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at))


@pytest.mark.parametrize("k", [1, 12, 40, 600])
def test_clusters_are_those_of_plain_k_means(spark, k):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"cluster": F.lit("mine"), "v": F.lit(0)})
    got = centroids.clustered(df, k=k, size=8).drop("looked")
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows, k, 5, 8)


def test_clusters_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None), (2, [1.0])]):
        got = centroids.clustered(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns[:3] == ["vec_id", "cluster", "distance"]


def test_bounds_spare_distances(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    looked = centroids.clustered(df).agg(F.avg("looked")).first()[0]
    assert looked < centroids.K / 4
