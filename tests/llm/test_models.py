"""Models and extraction: LM scoring, language ID, HTML text."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import odd
from tidemark.llm import html_text, langid, lm, trie

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]  # None is the end


def brute_lm(rows):
    """rows of (doc_id, text, train): the same formulas over dictionaries, without quantisation."""
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    for _, text, train in rows:
        if train:
            t = ["begin", *((x,) for x in tokens_of(text))]
            starts += 1
            one.update(t[1:])
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)
    count = lambda x: starts if x == "begin" else one[x]
    out = []
    for doc_id, text, _ in rows:
        t = ["begin", *((x,) for x in tokens_of(text))]
        base = score = 0.0
        for i in range(1, len(t)):
            p1 = (one[t[i]] + 0.5) / (n + 0.5 * (v + 1))
            p = (two[t[i - 1], t[i]] + lm.PAIR_PRIOR * p1) / (count(t[i - 1]) + lm.PAIR_PRIOR)
            if i > 1:
                p = (three[t[i - 2], t[i - 1], t[i]] + lm.TRIPLE_PRIOR * p) / (two[t[i - 2], t[i - 1]] + lm.TRIPLE_PRIOR)
            base, score = base + math.log10(p1), score + math.log10(p)
        out.append((doc_id, len(t) - 1, sum(one[x] > 0 for x in t[1:]), n, base, score))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_lm_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, many shards, and common words spread over them
        monkeypatch.setattr(lm, "BLOCK_TOKENS", 3000)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    docs = odd.documents(spark, clash=("train", "shard")).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    train = ~langid.held_out(F.col("doc_id"), 5, 1)
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.coalesce(train, F.lit(False))).collect()]
    order = lambda r: (repr(r[0]), r[1], r[2], round(r[4], 3))
    got, wanted = sorted((tuple(r) for r in lm.scored(docs, train).collect()), key=order), sorted(brute_lm(rows), key=order)
    assert [r[:4] for r in got] == [r[:4] for r in wanted]
    for a, b in zip(got, wanted):
        assert a[4] == pytest.approx(b[4], abs=1e-6)
        assert abs(a[5] - b[5]) <= 0.003 * b[1] + 1e-6  # half a step of the quantised probabilities for each token, and a bit


def test_lm_held_out_is_better_than_single_words(spark):
    r = lm.op1_lm_scoring(spark, SF2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*"), F.sum("n_tokens")).first()
    assert r[2] > 100 and r[0] > r[1] + 0.1 * r[3]


@pytest.mark.parametrize("small", [False, True])
def test_a_kept_model_scores_other_texts(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lm, "BLOCK_TOKENS", 3000)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    docs = odd.documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    train = F.coalesce(~langid.held_out(F.col("doc_id"), 5, 1), F.lit(False))
    model = lm.place(spark, "model")
    lm.fitted(docs.where(train), model)
    order = lambda r: (repr(r[0]), r[1], r[2], round(r[4], 3))
    wanted = sorted(brute_lm([tuple(r) for r in docs.select("doc_id", "text", train).collect()]), key=order)
    for _ in range(2):  # the model is not used up
        got = sorted((tuple(r) for r in lm.score_with(docs, model).collect()), key=order)
        assert [r[:4] for r in got] == [r[:4] for r in wanted]
        for a, b in zip(got, wanted):
            assert a[4] == pytest.approx(b[4], abs=1e-6) and abs(a[5] - b[5]) <= 0.003 * b[1] + 1e-6
    assert lm.score_with(odd.documents(spark, []), model).count() == 0
    nothing = lm.place(spark, "model")
    lm.fitted(odd.documents(spark, []), nothing)
    assert {(r.train_tokens, r.n_known) for r in lm.score_with(odd.documents(spark), nothing).collect()} == {(0, 0)}


def test_lm_without_rows_or_training(spark):
    assert lm.scored(odd.documents(spark, []), F.lit(True)).count() == 0
    got = lm.scored(odd.documents(spark), F.lit(False)).collect()
    assert len(got) == len(odd.DOCS) and all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0.0, abs=1e-6) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40), max_size=20))
def test_elias_fano(values, asked):
    values = sorted(values)
    s, a = trie.EliasFano.of(np.array(values, np.uint64), 2**40 + 1), np.array(values, np.uint64)
    assert s.values().tolist() == values
    if values:
        assert s.get(np.arange(len(values))).tolist() == values
    q = np.array(asked, np.uint64)
    assert s.successor(q).tolist() == np.searchsorted(a, q).tolist()


def brute_bits(texts, text):
    """Code length of a text by prediction by partial matching, from texts of one language."""
    order, seen = langid.ORDER, Counter()
    lower = lambda x: x.lower().encode()
    for t in map(lower, texts):
        padded = bytes([langid.PAD] * order) + t
        for i in range(len(t)):
            for k in range(order + 1):
                seen[padded[i + order - k : i + order], t[i]] += 1
    after = {}
    for (context, byte), n in seen.items():
        after.setdefault(context, {})[byte] = n

    def p(context, byte):
        lower_p = (lambda b: 1 / 256) if not context else (lambda b: p(context[1:], b))
        c = after.get(context)
        if not c:
            return lower_p(byte)
        n, d = sum(c.values()), len(c)
        if byte in c:
            return c[byte] / (n + d)
        return d / (n + d) * lower_p(byte) / (1 - sum(lower_p(b) for b in c))

    padded = bytes([langid.PAD] * order) + lower(text)
    return sum(-math.log2(p(padded[i : i + order], padded[i + order])) for i in range(len(lower(text))))


def test_language_model_equals_brute_force(spark):
    texts = {"en": ["the cat sat on the mat", "a dog and the cat", "the END"], "de": ["der hund und die katze", "die straße ist lang"]}
    df = spark.createDataFrame([(i, t, k) for k, v in texts.items() for i, t in enumerate(v)], "doc_id long, text string, lang string")
    ask = ["the dog sat", "Die Katze", "zzz qqq", "straße", "x"]
    got = langid.predict(spark.createDataFrame([(x,) for x in ask], "text string").withColumn("t", F.col("text")), langid.fit(df)).collect()
    for r in got:
        bits = {k: brute_bits(v, r.t) for k, v in texts.items()}
        least = min(bits, key=bits.get)
        assert r.n_bits == pytest.approx(bits[least], rel=1e-3)
        assert bits[r.lang_pred] == pytest.approx(bits[least], rel=1e-3)


def test_language_of_held_out_documents(spark):
    got = langid.op2_language_id(spark, SF2).join(spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100 and lang_pred <> 'und'")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("long"))).first()
    assert n > 100 and right >= 0.95 * n


def test_languages_of_long_and_of_many_texts_are_all_learned(spark):
    words = {"en": "the cat sat on the mat and then it ran home ", "de": "der hund und die katze gehen nach hause "}
    for long in (1_260_000, 1_040_000):
        rows = [(i, (words["de"] * (long // 40 + 1))[:long], "de") for i in range(3)] + [(9 + i, words["en"] * 20, "en") for i in range(5)]
        model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert model.languages == ["de", "en"]
    rows = [(None, " ".join(f"w{k}x{i % 7}" for i in range(50)), f"l{k:02d}") for k in range(60)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=64).languages == sorted({r[2] for r in rows})


def test_trees_are_no_larger_than_the_sample(spark):
    letters = [[chr(0x4E00 + 16 * k + i) for i in range(16)] for k in range(100)]  # languages of scripts that have nothing in common
    rows = [(k, " ".join("".join(letters[k][(i * j + j) % 16] for j in range(1, 9)) for i in range(400)), f"l{k:02d}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, total_bytes=100 * 2000)
    longest = max(len(t.encode()) for _, t, _ in rows)
    assert len(model.languages) == 100 and sum(len(o.keys) + len(o.contexts) for t in model.trees for o in t) <= 100 * 2 * (langid.ORDER + 1) * longest
    assert all((np.diff(o.keys.astype(np.int64)) > 0).all() and np.isfinite(o.bits).all() and np.isfinite(o.escapes).all() for t in model.trees for o in t)
    got = langid.predict(df.select("lang", F.substring("text", 40, 60).alias("text")), model)
    assert got.where("lang = lang_pred").count() == 100


def test_language_of_odd_rows(spark):
    docs = odd.documents(spark, clash=("n_bits", "score"))
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(odd.DOCS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (6, 9, 15))
    assert langid.predict(odd.documents(spark, []), model).count() == 0
    none = langid.fit(odd.documents(spark, []))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    only = spark.createDataFrame([("1234 ... !",), ("你好",)], "text string")
    assert [r.lang_pred == "und" for r in langid.predict(only, model).collect()] == [True, False]


def test_held_out_remainders(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").withColumn("h", langid.held_out(F.col("doc_id"), 5, 1))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in df.collect())


PARAGRAPHS = ["The first paragraph of the story says that a ship came in at dawn.", "A second one, with <b>bold</b>  words &amp; an\n entity, goes on for a while.", "The third ends it all, as the crew went home to sleep."]
TEXT = "The first paragraph of the story says that a ship came in at dawn.\nA second one, with bold words & an entity, goes on for a while.\nThe third ends it all, as the crew went home to sleep."
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
JUNK = '<nav><a href="/">Home</a> <a href="/x">News and more news of the day</a></nav><div class="cookie-notice">We use cookies to make all of this better for you.</div>'
END = '<div id="comments"><p>I liked this story very much, thank you for it all.</p></div><aside>Other stories that you may like to read today.</aside><footer>Copyright and all the rest of it, 2024</footer>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p {{}}</style></head><body>{JUNK}<article>{BODY}</article>{END}</body></html>",
        f"<html><body>{JUNK}<div class='content'>{BODY}</div>{END}</body></html>",
        f"{JUNK}<main>{BODY}<script>var x = '</p><p>not this';</script><!-- nor <p>this</p> --></main>{END}",
        f"<body>{JUNK}<div>{BODY}</div><form><p>Your name and your address, please, and then send it.</p><input type=text><button>Send</button></form>",
    ],
)
def test_main_text(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f'<body>{JUNK}<div style="overflow:hidden">{BODY}</div>{END}</body>',
        f"<body>{JUNK}<div title='a hidden gem' data-x='display:none'>{BODY}</div>{END}</body>",
        f'<article>{BODY.replace("<b>bold</b>", "<a href=/the/hidden/valley>bold</a>")}<p hidden>Not seen.</p><p style="color:red; display : none">Nor this.</p><p aria-hidden=true>Nor that.</p></article>',
        f'<body>{JUNK}<div class="content no-sidebar">{BODY}</div>{END}</body>',
        f"<body>{JUNK}<div><h2 class='page-header'>{PARAGRAPHS[0]}</h2>{BODY[len(PARAGRAPHS[0]) + 7 :]}</div><div id='comment_12'>I liked it.</div><div class='navMenu'>Home</div>{END}</body>",
        f"<body>{JUNK}<article><p>{PARAGRAPHS[0]}</p></article><article class='comment'><p>Not one of us, said {'a reader ' * 40}</p></article><article><p>{PARAGRAPHS[1]}</p></article><article><p>{PARAGRAPHS[2]}</p></article>{END}</body>",
        f"<body>{JUNK}<main><article>{BODY}</article></main><article class='related'><p>Another story.</p></article>{END}</body>",
    ],
)
def test_main_text_is_whole(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '<b \"", "<!", "</", "<article>", "<p hidden>", "<div class=ad><article></article>", "<nav>", "&lt", "<script", "<!--"])
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 12


def test_stretches_by_their_own_links():
    long, ad = "".join(f"<p>{'a long paragraph of a story ' * 30}</p>" for _ in range(3)), '<div class="ad">Buy now</div>'
    page = f'<body><div>{long}</div>{ad}<div><p>It was short.</p></div>{ad}<div><a href="/a">One story</a> <a href="/b">Two stories</a></div></body>'
    found = html_text.main_text(page).split("\n")
    assert len(found) == 4 and found[-1] == "It was short."
    assert html_text.main_text("<div><a href=/x>only links</a></div>") == "only links"
    assert html_text.main_text("<div><a href=/x>never closed<p>but a text</p></div>") == "never closed\nbut a text"


def test_html_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (3, "plain"), (None, "<p"), (4, "<div>" * 3000 + "deep"), (5, f"<article>{'<p>word</p>' * 20_000}</article>")], "page_id long, html string").withColumn("text", F.lit("mine")).withColumn("url", F.lit("u"))
    got = html_text.extracted(pages).collect()
    found = {r.page_id: r.text for r in got}
    assert len(got) == 7 and found[1] == found[2] == "" and found[3] == "plain" and found[4] == "deep" and found[5] == "\n".join(["word"] * 20_000)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extracted(pages.limit(0)).count() == 0
