"""Memory that steps of the n-gram Jaccard join take beside what they are given."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import jaccard, words


def peak(f) -> int:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_of_columns_is_sorted_in_ranges():
    draw = np.random.default_rng(1)
    n, each = 8192, 64
    grams = draw.integers(0, 1 << 63, (n, each)).astype(np.uint64)
    grams[1] = grams[0]  # all but these columns have one row
    parts = np.array_split(np.arange(n), 16)
    packed = lambda f: pa.array([f(p).tobytes() for p in parts], pa.binary())
    t = pa.table({"classes": packed(lambda p: p.astype(np.uint64)), "sizes": packed(lambda p: np.full(len(p), each, np.uint32)), "counts": packed(lambda p: np.full(len(p), each, np.uint32)), "grams": packed(lambda p: grams[p])})
    out = []
    assert peak(lambda: out.append(jaccard._shared(t, 3))) < grams.nbytes
    assert sorted(np.frombuffer(b"".join(out[0]["grams"].to_pylist()), np.uint64)) == sorted(np.concatenate((grams[0], grams[0])))


def test_words_of_a_long_group_are_hashed_in_stretches():
    words.powers(1)
    texts = pa.array(["some words " * 100_000, "x" * 900_000 + " words", "words"])
    (group,) = words.groups(texts, 4 << 20)
    found = []
    assert peak(lambda: found.append(group.hashes())) < 20 * len(group.data)
    short = [next(words.groups(pa.array([x]))).hashes() for x in ("some", "words", "x" * 900_000)]
    assert found[0][:4].tolist() == [short[0][0], short[1][0]] * 2 and found[0][-3:].tolist() == [short[2][0], short[1][0], short[1][0]]
