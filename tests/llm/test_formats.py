"""Operators that write files or formats: WARC, chat, token files, mixing."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import odd
from tidemark.llm import chat, mixing, store, tables, token_files, warc

SF = "/root/testdata/sf0.001"
PAGES = [(1, "http://a/ü b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "u\r\nX: y", "é" * 300_000), (5, "again", "é" * 300_000), (None, "n", "<p>x</p>"), (9, "z", "only one")]


def pages(spark, rows=None):
    return spark.createDataFrame(PAGES if rows is None else rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).withColumn("shard", F.lit("mine"))


def brute_records(rows, least=0):
    first = {}
    for page, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and page is not None:
            first[p] = min(first.get(p, page), page)
    out, used = [], set()
    for page, url, html in rows:
        p = (html or "").encode()
        revisit = len(p) >= least and p in first and (first[p] != page or p in used)
        if first.get(p) == page:
            used.add(p)
        out.append((page, url, len(p), warc.base32_sha1(p), "revisit" if revisit else "response", first[p] if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 5, 1 << 30])
def test_warc_of_odd_rows(spark, least):
    uri = tables.place(spark, "w")
    warc.write(pages(spark), uri, min_bytes=least)
    got = [tuple(r)[:6] for r in warc.read(spark, uri).collect()]
    pick = lambda rows: Counter((r[0], r[2], r[3], r[4], r[5]) for r in rows)
    assert pick(got) == pick(brute_records(PAGES, least))
    assert Counter(r[1] for r in got) == Counter(p[1] for p in PAGES)


def test_warc_shards_of_far_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 40_000)
    rows = [(i, f"u{i}", f"page {i} " * 200) for i in range(200)] + [(2**40, "far", "x"), (2**63 - 1, "top", "y"), (-(2**63), "low", "page 1 " * 200)]
    rows += [(77, f"v{i}", f"hot {i} " * 200) for i in range(100)] + [(None, f"n{i}", f"none {i} " * 200) for i in range(100)]
    uri = tables.place(spark, "w")
    made = warc.write(pages(spark, rows), uri).collect()
    by = Counter()
    for r in made:
        by[r.shard] += r.records
    assert len(by) > 10 and max(by.values()) < 60
    got = [tuple(r)[:6] for r in warc.read(spark, uri).collect()]
    pick = lambda rows: Counter((r[0], r[2], r[3], r[4], r[5]) for r in rows)
    assert pick(got) == pick(brute_records(rows))


def test_warc_is_the_same_again(spark):
    crcs = []
    for parts in (1, 7):
        uri = tables.place(spark, "w")
        warc.write(spark.read.parquet(f"{SF}/pages.parquet").repartition(parts), uri)
        crcs.append(sorted(tuple(r) for r in warc.manifest(spark, uri).collect()))
    assert crcs[0] == crcs[1] and crcs[0]


def test_warc_without_pages_and_damage(spark):
    uri = tables.place(spark, "w")
    assert warc.write(pages(spark, []), uri).count() == 0
    uri = tables.place(spark, "w")
    name = warc.write(pages(spark), uri).first()["name"]
    fs, path = store.opened(uri)
    with fs.open_input_file(f"{path}/{name}") as f:
        content = bytearray(f.read())
    content[-9] ^= 1
    store.commit(uri, name, bytes(content))
    with pytest.raises(Exception):  # noqa: B017
        warc.read(spark, uri).collect()


def brute_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat.CONTROL), (-1, 1, "assistant", chat.CONTROL)]
    assert {r.conv_id: tuple(r)[1:5] for r in chat.op8_chat(spark, SF).collect()} == brute_chat(rows)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "<\\|im_end|>"), (1, 2, "assistant", "<|im_start|>user\nx<|im_end|>\n"), (2, 0, "a\\n\nb", ""), (None, 0, "assistant", "long " * 50_000), (3, None, "assistant", "<|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine")).withColumn("loss_start", F.lit("mine"))
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.formatted(df)).collect()} == brute_chat(rows)
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
    repeated = chat.formatted(df.where("conv_id = 2").unionByName(df.where("conv_id = 2")))
    assert repeated.count() == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>ims_endtar\n x", max_size=40), st.text(alphabet="<|\\\nn_", max_size=20))
def test_chat_escapes_are_reversible(text, role):
    formatted = chat.format_turn(role, text, chat.Costs())["formatted"]
    assert [(r, chat.unescape(c)) for r, c in chat.read_turns(formatted)] == [(role, text)]
    assert formatted.count("<|") == 2


def test_chat_parts(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    content = [part(type="text", text="see "), part(type="image", ref="i.png", width=57, height=28), None, part(type="audio", ref="a.wav", seconds=2.0), part(type="document", ref="d.pdf", pages=3), part(text="<|image|>")]
    df = spark.createDataFrame([(1, 0, "assistant", content), (2, 0, "user", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.formatted(df, "content").where("conv_id = 1").first()
    body = r.formatted[r.loss_start : r.loss_end]
    assert body == "see <|image|><|audio|><|document|><\\|image|>"
    assert [(a.kind, a.ref, a.tokens, r.formatted[a.position :].startswith(chat.PLACEHOLDERS[a.kind])) for a in r.attachments] == [("image", "i.png", 3, True), ("audio", "a.wav", 25, True), ("document", "d.pdf", 1536, True)]
    assert r.attachment_tokens == 3 + 25 + 1536


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packing_is_reversible(bits, ids):
    a = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    data = token_files.pack(a, bits)
    assert len(data) == -(-len(a) * bits // 8) and token_files.unpack(np.frombuffer(data, np.uint8), len(a), bits).tolist() == a.tolist()


def test_random_access():
    ids = (np.arange(10_000, dtype=np.uint32) * 7919) % 49408
    f = token_files.TokenFile(token_files.to_file([1, None], np.array([9000, 1000]), ids, 16, 0, 0, block=512))
    assert f.doc_ids == [1, None] and all(f.ids(a, b).tolist() == ids[a:b].tolist() for a, b in ((0, 0), (5, 600), (511, 513), (9_999, 10_000), (0, 10_000)))


def test_token_files_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    extra = [(10**9 + i, x, None, None) for i, x in enumerate(["<|endoftext|> <|EndOfText|>", "don't it's 3,000.5 A.B. x. y,z ...", "Ünïcode ÀÉ ß ÿ ÷ ×", "a b c\x1cd\x85e", "é ﬁ İ K", odd.LONG * 20])]
    docs = odd.documents(spark, [*odd.DOCS, *extra], clash=("start", "tie")).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    uri = tables.place(spark, "t")
    token_files.write(docs, uri, path, 49408, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.digest) for r in token_files.read(spark, uri, token_files.crc_of_ids).collect()), key=lambda r: r[0])
    wanted = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter(r[1:] for r in got) == wanted
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    ids = [r[1] for r in got if r[1] is not None]
    assert ids == sorted(ids) and all(r[1] is None for r in got[: len(got) - len(ids)])
    assert sorted(len(r.ids) for r in token_files.read(spark, uri).collect()) == sorted(r[2] for r in got)
    empty = tables.place(spark, "t")
    token_files.write(odd.documents(spark, []), empty, path, 49408, 2)
    assert token_files.read(spark, empty, token_files.crc_of_ids).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] for s in held} | share
        held |= over


def mix_rows(spark, n=3000):
    rows = [(i, " ".join(["w"] * (1 + (i * i) % 40)), None, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 11}") for i in range(n)]
    return odd.documents(spark, [*rows, *odd.DOCS])


@pytest.mark.parametrize("bucket", [4096, 16])
def test_mix_meets_its_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)  # the small one makes a tree of buckets
    monkeypatch.setattr(mixing, "FAN", 4)
    docs = mix_rows(spark).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    rows = docs.withColumn("mix_key", F.xxhash64("doc_id", "source", "size"))
    got, again = ([tuple(r) for r in mixing.copies(x).select("doc_id", "source", "size", "source_size", "target", "copies").collect()] for x in (rows, rows.repartition(13)))
    assert Counter(got) == Counter(again) and len(got) == rows.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, source, size, _, _, copies in got:
        sizes[source] += size
        taken[source] += copies * size
        largest[source] = max(largest[source], size)
        assert 0 <= copies <= 3
    wanted = brute_targets(sizes)
    for _, source, _, source_size, target, _ in got:
        assert source_size == sizes[source] and target == pytest.approx(wanted[source])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in sizes)


def test_pivotal_keeps_expectations():
    size, p = np.array([7.0, 3.0, 11.0, 2.0, 5.0]), np.full(5, 0.37)
    rng, seen = np.random.default_rng(1), np.zeros(5)
    for _ in range(20_000):
        out, at = mixing.pivotal(size, p, rng)
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        seen += out
    assert np.allclose(seen / 20_000, 0.37, atol=0.02)


def test_rounding_pairs_small_rows_and_keeps_sums(monkeypatch):
    paired = []
    pivotal = mixing.pivotal
    monkeypatch.setattr(mixing, "pivotal", lambda size, *x: (paired.append(len(size)), pivotal(size, *x))[1])
    rng = np.random.default_rng(3)
    size = np.sort(np.concatenate((rng.integers(1, 90, 300), [2000, 3000]))).astype(float)[::-1].copy()
    seen = np.zeros(len(size))
    for _ in range(2000):
        out = mixing.rounded(size, 0.3, rng)
        open_rows = (out > 0) & (out < 1)
        assert abs((out * size).sum() - 0.3 * size.sum()) < 1e-6 and open_rows.sum() <= 1 and (size[open_rows] < 1000).all()
        seen += out
    assert np.allclose(seen / 2000, 0.3, atol=0.06) and set(paired) == {300}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_most_rows_of_small_sources_are_paired(spark, monkeypatch, sf):
    paired = []
    pivotal = mixing.pivotal
    monkeypatch.setattr(mixing, "pivotal", lambda size, *x: (paired.append(len(size)), pivotal(size, *x))[1])
    by = defaultdict(list)
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("source", mixing.n_words(F.col("text")).alias("size")).collect():
        by[r.source].append(float(r["size"]))
    rng = np.random.default_rng(1)
    for sizes in by.values():
        size = np.array(sorted(sizes, reverse=True))
        errors = [abs((mixing.rounded(size, 0.37, rng) - 0.37) @ size) for _ in range(20)]
        assert max(errors) < 1e-6  # what is open keeps the sum
    n = sum(map(len, by.values()))
    assert sum(paired) / 20 > n / 2


def test_small_sources_are_paired_and_combined_in_the_tree(spark, monkeypatch):
    levels = []
    step = mixing._step
    monkeypatch.setattr(mixing, "_step", lambda seed, level, last: (levels.append((level, last)), step(seed, level, last))[1])
    got = mixing.op10_mixing(spark, SF).collect()
    assert levels == [(1, True)]
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - t) <= largest[s] for s, t in target.items())


def test_mixed_rows_keep_their_columns(spark):
    docs = odd.documents(spark, clash=("size", "copies", "bucket", "mix_key"))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    assert mixing.mixed(odd.documents(spark, [])).count() == 0
    assert mixing.mixed(odd.documents(spark, [(1, None, None, "a"), (2, "", None, None)])).count() == 0
