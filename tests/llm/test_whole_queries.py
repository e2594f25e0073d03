"""Registered queries over tables with texts of more than half a megabyte, words and n-grams that all rows have, and many equal rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import odd
from test_formats import PAGES, brute_records, brute_targets
from test_models import brute_lm
from test_text_rules import brute_components
from tidemark.llm import jaccard, lm, mixing, quality, token_files, warc, words

RNG = random.Random(11)
MANY = [f"{RNG.choice('abcdefgh')}{RNG.randrange(4000)}" for _ in range(105_000)]
NEAR = [x if i % 4000 else "other" for i, x in enumerate(MANY)]
TEXTS = [
    (101, " ".join(MANY)), (102, "  ".join(NEAR)), (103, "x" * 700_000), (104, "\n".join(["é ß"] * 120_000)), (105, " \t\n" * 250_000),
    (106, ("one line that comes again and again\n") * 20_000), (5, " ".join(MANY)),
]
ROWS = [*odd.DOCS, *((i, t, "en", "long") for i, t in TEXTS)]


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    assert sum(len(t.encode()) > words.GROUP for _, t in TEXTS) == len(TEXTS)
    pages = spark.createDataFrame([*PAGES, (20, "long", "<p>" + "word " * 300_000)], "page_id long, url string, html string")
    return odd.tables(str(tmp_path_factory.mktemp("t") / "t"), documents=odd.documents(spark, ROWS), pages=pages)


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, again = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            again.update((i, i + 1, i + 2))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_quality_of_long_texts(spark, at):
    got = quality.op5_quality_rules(spark, at).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *brute_quality(r[1])) for r in ROWS)


def test_links_of_long_texts(spark, at):
    got = jaccard.op7_ngram_jaccard(spark, at).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components([r[:2] for r in ROWS])
    assert {r.component_id for r in got if r.doc_id in (101, 102)} == {5}


def test_scores_of_long_texts(spark, at):
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = {(r[0], r[1]): r for r in brute_lm([(i, t, i is None or not out(i)) for i, t, *_ in ROWS])}
    got = lm.op1_lm_scoring(spark, at).collect()
    assert len(got) == len(ROWS)
    for r in got:
        _, n, known, tokens, base, score = want[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens) == (known, tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-6) and abs(r.score - score) <= 0.003 * n + 1e-6


def test_token_files_of_long_texts(spark, at):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(token_files.op9_token_files(spark, at).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_archives_of_the_query(spark, at):
    pages = [*PAGES, (20, "long", "<p>" + "word " * 300_000)]
    got = warc.op6_warc(spark, at).collect()
    want = Counter((r[0], r[2], r[3], r[4], r[5]) for r in brute_records(pages))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want




def test_mix_of_long_texts_and_of_equal_rows(spark, at):
    got = mixing.op10_mixing(spark, at).collect()
    sizes = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size) for r in got) == sizes and all(0 <= r.taken <= 3 * r.size for r in got)
    # all rows of a source alike, and a source of others: what is taken is near the target to a row of the largest size
    rows = [(7, "the same six words each time", "en", "equal")] * 4000 + [(i, "w " * (i % 90), "en", f"s{i % 4}") for i in range(3000)]
    folder = odd.tables(at + "-equal", documents=odd.documents(spark, rows))
    found = mixing.op10_mixing(spark, folder).collect()
    targets = {r.source_size: r.target for r in found}
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(text.split())
    want = brute_targets(dict(size))
    assert {size[s]: pytest.approx(t) for s, t in want.items()} == targets
    taken = Counter()
    for r in found:
        taken[r.source_size] += r.taken
    assert all(abs(taken[size[s]] - t) <= 2 * 90 for s, t in want.items())
    assert abs(taken[size["equal"]] - want["equal"]) <= 6


def test_a_shingle_that_all_documents_have(spark):
    rng = random.Random(2)
    rows = [(i, f"all rights of this page are reserved {' '.join(f'n{rng.randrange(10**6)}' for _ in range(rng.randrange(12, 30)))}") for i in range(600)]
    rows += [(5000 + i, rows[i][1] + (" and" if i % 2 else "")) for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.linked(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)
