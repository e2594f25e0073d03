"""The pipeline's stages, each against SQL or a count over what the stage before it kept."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
import odd
from tidemark.llm import decontamination, jaccard, quality
from tidemark.llm.tables import table
from tidemark.plans import lineage

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The folder of each stage's input, with the benchmark, and the last result."""
    at, docs = [], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert docs.columns == COLUMNS
        at.append(odd.tables(str(tmp_path_factory.mktemp(name) / "t"), documents=docs, benchmark=table(spark, SF, "benchmark")))
        docs = stage(spark, table(spark, at[-1], "documents"), SF)
    return at, docs


def ids(spark, at):
    return Counter(r.doc_id for r in table(spark, at, "documents").select("doc_id").collect())


def test_quality(spark, steps):
    at, _ = steps
    kept = odd.sql_rows(at[0], f"select doc_id from ({quality.OP5_SQL.strip()}) where kept")
    assert ids(spark, at[1]) == Counter(r[0] for r in kept) and 0 < len(kept) < sum(ids(spark, at[0]).values())


def test_near_copies(spark, steps):
    at, _ = steps
    kept = odd.sql_rows(at[1], f"select doc_id from ({jaccard.OP7_SQL.strip()}) where doc_id = component_id")
    assert ids(spark, at[2]) == Counter(r[0] for r in kept)


def test_benchmark(spark, steps):
    at, _ = steps
    leaked = {r[0] for r in odd.sql_rows(at[2], f"select distinct doc_id from ({decontamination.OP3_SQL.strip()})")}
    before = ids(spark, at[2])
    assert leaked and ids(spark, at[3]) == Counter({k: n for k, n in before.items() if k not in leaked})


def test_mix_and_tokens(spark, steps):
    at, last = steps
    before, after = ids(spark, at[3]), ids(spark, at[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    assert Counter(r.doc_id for r in last.collect()) == after


def test_run_is_the_stages_in_turn(spark, steps):
    _, last = steps
    pick = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert pick(__spark_entry__.queries()["pipeline"](spark, SF)) == pick(last)


def test_stages_leave_nothing_but_the_last_input(spark):
    at = lineage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    found = corpus_pipeline.run(spark, SF)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before}
    assert {x for x in left if x.startswith("stage-")} == {"stage-mixing"}
    assert not left & {"item-words", "items", "windows", "texts", "window-words", "window-shingles"}
    assert found.count() > 0


def test_odd_and_empty_documents(spark, tmp_path):
    for i, rows in enumerate((None, [])):
        at = odd.tables(str(tmp_path / f"t{i}"), documents=odd.documents(spark, rows).select(*COLUMNS), benchmark=odd.benchmark(spark, rows))
        found = corpus_pipeline.run(spark, at).collect()
        assert bool(found) == (rows is None)
