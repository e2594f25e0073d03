"""Operators that SQL can express: quality rules, n-gram Jaccard join, decontamination."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
import odd
from tidemark.llm import decontamination, jaccard, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert compare.differences(spark, SF, name) == ""


def test_quality_of_odd_rows(spark, tmp_path):
    at = odd.tables(str(tmp_path / "t"), documents=odd.documents(spark))
    assert compare.differences(spark, at, "op5_quality_rules") == ""


def test_ablation_equals_counting(spark):
    ledger = quality.ledger(odd.documents(spark))
    failed = [r.failed_rules for r in ledger.collect()]
    m = quality.mask("full-1")
    for r in quality.ablation(ledger, "full-1").collect():
        bit = quality.mask("full-1") & {x.name: 1 << i for i, x in enumerate(quality.RULES)}[r.rule]
        assert (r.rejected, r.alone, r.kept_without) == (sum(bool(f & bit) for f in failed), sum(f & m == bit for f in failed), sum(not f & m & ~bit for f in failed))


def test_quality_keeps_columns_and_empty_tables(spark):
    docs = odd.documents(spark, clash=("n_words", "failed_rules", "c0", "measured_text"))
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert {r.n_words for r in kept.collect()} <= {"kept"}
    assert quality.filtered(odd.documents(spark, [])).count() == 0
    assert [r.rejected for r in quality.ablation(quality.ledger(odd.documents(spark, [])), "base-1").collect()] == [0, 0]


def brute_components(rows, n=5):
    sets = {}
    for i, (doc_id, text) in enumerate(rows):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in w).split(" ") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_of_odd_rows(spark):
    docs = odd.documents(spark, clash=("class", "size", "gram"))
    got = jaccard.linked(docs)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_components([(d[0], d[1]) for d in odd.DOCS])
    assert jaccard.linked(odd.documents(spark, [])).count() == 0


def test_jaccard_of_chains_and_groups(spark):
    rng = random.Random(3)
    rows, base = [], [f"b{i}" for i in range(60)]
    for i in range(40):  # a chain: each differs from the one before in a few words, so ends don't link
        base = base[2:] + [f"n{i}", f"m{i}"]
        rows.append((1000 - i, " ".join(base)))
    seed = [f"g{i}" for i in range(50)]
    for i in range(60):  # a group of near copies at all similarities around the bound
        copy = list(seed)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(50)] = f"r{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, "just three words") for i in range(3)] + [(2010, "the just three words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.linked(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_components(rows)


def test_representatives_keep_columns(spark):
    docs = odd.documents(spark, clash=("class", "component_id", "root"))
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {6, 9, 11} <= ids and not {7, 10, 12} & ids


def test_representatives_go_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, f"{x} unrelated text of its own number {x}") for x in range(50)]  # null ids that link with nothing
    rows += [(None, None), (None, ""), (3, None), (3, " \n")]  # no words: all stay
    rows += [(1, a), (5, a + " end"), (5, b), (None, a)]  # one id for a copy of a smaller id's text and for a text of its own
    rows += [(None, c), (None, c + " end"), (9, c), (9, c), (9, c + " end")]  # a component with null ids, and with one id twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("mine")).withColumn("root", F.lit("mine"))
    kept = jaccard.representatives(docs.repartition(5))
    assert kept.columns == docs.columns and {r.key for r in kept.collect()} == {"mine"}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    of_c = [x for x in got if (x[1] or "").startswith("c0 ")]
    assert len(of_c) == 1 and of_c[0][0] == 9
    assert sorted((x for x in got if x not in of_c), key=repr) == sorted(rows[:54] + [(1, a), (5, b)], key=repr)
    assert jaccard.representatives(docs.limit(0)).count() == 0


def test_pipeline_stage_keeps_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"{x} is a text that stands by itself, number {x}", "en", "a") for x in range(20)], odd.SCHEMA)
    assert corpus_pipeline.near_copies_stage(spark, docs, "").count() == 20


def test_leaks_of_odd_rows_equal_sql(spark, tmp_path):
    at = odd.tables(str(tmp_path / "t"), documents=odd.documents(spark), benchmark=odd.benchmark(spark))
    assert compare.differences(spark, at, "op3_decontamination") == ""
    found = {(r.doc_id, r.item_id) for r in decontamination.op3_decontamination(spark, at).collect()}
    assert {(11, 1), (12, 1), (13, 1), (12, 5), (4, 4), (5, 4), (16, None)} <= found


def test_near_passages_and_clean_documents(spark):
    w = odd.ITEM.split()
    one, third = [*w[:-1], "X"], [x if i % 4 else "X" for i, x in enumerate(w)]
    texts = [(1, f"lead in text {' '.join(one)} and more"), (2, " ".join(third)), (3, " ".join(sorted(w))), (4, " ".join(w[:10]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("doc_key", F.lit("mine"))
    items = spark.createDataFrame([(7, odd.ITEM)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.clean(docs, items).collect()) == [2, 3, 4]
    assert [round(r.similarity, 6) for r in decontamination.leaks(docs, items).collect()] == [round(similarity(one, w), 6)]
    assert decontamination.clean(docs, items).columns == docs.columns


def test_leaks_at_the_bound_with_far_prints(spark):
    # pairs of a similarity of just over 0.75, whose SimHash prints differ in 30, 29 and 29 of 64 bits
    pairs = [
        ("gxq jdj zgxk ryy qvtcj bts ftz dopdz kqw mfnev tvu vpvgg", "nqlup"),
        ("kjk ern ysu jnqi jigml rkx mei hyql ena vbtac sxve nshhc", "xaq"),
        ("ldt mql qbmh oqjl yyxh aff kop ralcl zxt xrmrn cmu hzl", "blsqh"),
    ]
    texts = [" ".join([*w.split()[:-1], end]) for w, end in pairs]
    docs = spark.createDataFrame([(i, f"it says {x} here") for i, x in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(pairs)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontamination.leaks(docs, items).collect()}
    best = lambda x, w: max(similarity(x[i : i + len(w)], w) for i in range(len(x) - len(w) + 1))
    assert got == {(i, i): round(best(f"it says {x} here".split(), w.split()), 6) for i, (x, (w, _)) in enumerate(zip(texts, pairs))}
    assert all(round(similarity(x.split(), w.split()), 6) <= got[i, i] for i, (x, (w, _)) in enumerate(zip(texts, pairs)))
    assert decontamination.clean(docs, items).count() == 0


def test_leaks_with_words_put_in_and_left_out_equal_brute_force(spark):
    rng = random.Random(5)
    items = [[f"{x}{i}" for i in range(n)] for x, n in (("a", 14), ("b", 25), ("c", 40), ("d", 7))]
    texts = []
    for i in range(60):
        w = list(items[i % 4])
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = ["new"] * rng.randrange(2)
        texts.append(["lead", "in"][: rng.randrange(3)] + w + ["and", "out"][: rng.randrange(3)])
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    wanted = {}
    for i, x in enumerate(texts):
        for q, w in enumerate(items):
            best = max(similarity(x[s : s + len(w)], w) for s in range(max(1, len(x) - len(w) + 1)))
            if best >= 0.75:
                wanted[i, q] = round(best, 6)
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontamination.leaks(docs, bench).collect()} == wanted and len(wanted) > 10


def test_many_items_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 3)
    docs = spark.createDataFrame([(i, f"n{i} {odd.ITEM}") for i in range(60)], "doc_id long, text string")
    found = decontamination.leaks(docs, odd.benchmark(spark)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted((i, q) for i in range(60) for q in (1, 5))


def similarity(a, b):
    s = lambda x: {tuple(y.lower() for y in x[i : i + 5]) for i in range(len(x) - 4)}
    weight = lambda y: sum(len("".join(t)) for t in y)
    return weight(s(a) & s(b)) / weight(s(a) | s(b))


def test_no_items_and_no_documents(spark):
    assert decontamination.leaks(odd.documents(spark), odd.benchmark(spark, [])).count() == 0
    assert decontamination.leaks(odd.documents(spark, []), odd.benchmark(spark)).count() == 0
    assert decontamination.clean(odd.documents(spark), odd.benchmark(spark, [])).count() == len(odd.DOCS)


def test_a_long_text_that_repeats_an_item(spark):
    rng = random.Random(1)
    item = " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    text = " ".join([item] * 2000)  # above half a megabyte
    docs = spark.createDataFrame([(1, text), (2, f"{text[:2000]} {'other words ' * 60_000}"), (3, f"x {item}")], "doc_id long, text string")
    got = decontamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.position, r.similarity) for r in got.collect()) == [(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0)]
