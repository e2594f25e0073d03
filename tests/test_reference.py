from __future__ import annotations

import os
import random
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

import compare
from tidemark.functions import web
from tidemark.functions.text import receipt
from tidemark.operators import memory, metering, pages, retrieval
from tidemark.plans import commits, lineage, reference
from tidemark.sources import folder, pdf
from tidemark.sources import web as web_source
from tidemark.streaming import monitors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_query_equals_sql(spark, name):
    assert compare.differences(spark, SF, name) == ""


def test_all_queries_have_sql():
    assert set(reference.QUERIES) - set(reference.SQL) == {"vector_search"}


def a_log(spark, rows):
    df = spark.createDataFrame(rows, "key string, value double, writer string, at string, seq long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    return memory.Log(df)


WRITES = [("a", 1.0, "x", "2024-01-01", 1), ("a", 2.0, "y", "2024-01-02", 2), ("a", None, "y", "2024-01-03", 3), ("b", 5.0, "x", "2024-01-01", 4), ("c", 7.0, "z", "2024-01-03", 5), ("b", 6.0, "z", "2024-01-01", 6)]


def test_state_changes_and_removal(spark):
    log = a_log(spark, WRITES)
    assert sorted((r.key, r.value) for r in memory.state(log).collect()) == [("b", 6.0), ("c", 7.0)]
    assert sorted((r.key, r.value) for r in memory.state(log, "2024-01-02").collect()) == [("a", 2.0), ("b", 6.0)]
    found = {r.key: r.change for r in memory.changes(log, "2024-01-02", "2024-01-04").collect()}
    assert found == {"a": "removed", "b": "same", "c": "added"}


def test_rollback_brings_the_old_state_back(spark):
    log = a_log(spark, WRITES)
    back = memory.appended(log, memory.rollback(log, "2024-01-02"), "me", "2025-01-01")
    pick = lambda df: sorted((r.key, r.value) for r in df.collect())
    assert pick(memory.state(back)) == pick(memory.state(log, "2024-01-02"))


def test_undo(spark):
    found = {r.key: (r.undone_value, r.value) for r in memory.undo(a_log(spark, WRITES)).collect()}
    assert found == {"a": (None, 2.0), "b": (6.0, 5.0), "c": (7.0, None)}


def test_chain_shows_any_change(spark):
    links = lambda rows: {r.seq: r.link for r in memory.chained(a_log(spark, rows), F.col("value")).collect()}
    one, two = links(WRITES), links([("a", 1.5, *WRITES[0][2:]), *WRITES[1:]])
    assert {s for s in one if one[s] != two[s]} == {1, 2, 3}


def test_empty_log(spark):
    log = a_log(spark, [])
    for df in (memory.history(log), memory.state(log), memory.provenance(log), memory.undo(log), memory.rollback(log, "2024-01-01"), memory.chained(log, F.col("value"))):
        assert df.count() == 0


def test_markdown_round_trip(spark, tmp_path):
    made = memory.markdown(spark.createDataFrame([(1, 0, "user", "hi\nyou"), (1, 1, "assistant", "yes"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string"))
    folder.write_markdown(made, str(tmp_path / "md"))
    back = {r.conv_id: r.content for r in folder.read_markdown(spark, str(tmp_path / "md")).collect()}
    assert back == {r.conv_id: r.content for r in made.collect()}


def test_crawl_on_a_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source string, target string")
    found = pages.crawl(spark.createDataFrame([("a",), ("a",)], "url string"), edges, 3)
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_links_are_resolved(spark):
    df = spark.createDataFrame([("https://www.x.org/a/b?utm_source=1&q=2#f", h) for h in ("/c", "d", "//y.org/z/", "http://q.org/?ref=1")], "url string, href string")
    got = [r[0] for r in df.select(web.canonical(web.resolved(F.col("url"), F.col("href")))).collect()]
    assert got == ["https://x.org/c", "https://x.org/a/d", "https://y.org/z", "https://q.org"]
    assert df.select(web.canonical(F.col("url"))).first()[0] == "https://x.org/a/b?q=2"


def test_merged_results(spark):
    df = spark.createDataFrame([(1, 1, "a b c d"), (2, 2, "d c b a"), (3, 3, "e f")], "doc_id long, rank long, text string")
    assert sorted(r.doc_id for r in retrieval.merged(df, "doc_id", "text").collect()) == [1, 3]


def test_rows_that_differ_have_other_receipts(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("x", None), ("x", ""), ("a|b", "c"), ("a", "b|c"), ("1:a,", "b"), ("1:a", ",b"), ("-", "x")], "a string, b string")
    assert len({r[0] for r in df.select(receipt(F.col("a"), F.col("b"))).collect()}) == df.count()


def test_merged_results_are_those_of_all_pairs(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.sample(words, draw.randint(1, 12))) for _ in range(60)]
    texts += [" ".join(draw.sample(t.split(), len(t.split()) - (len(t) > 12))) for t in texts] + ["", None, "", *texts[:20]]
    draw.shuffle(texts)
    rows = [(i, i + 1, t) for i, t in enumerate(texts)]
    sets = [set((t or "").split()) for t in texts]
    want = [i for i, s in enumerate(sets) if not any(100 * len(s & o) >= 75 * len(s | o) for o in sets[:i])]
    got = retrieval.merged(spark.createDataFrame(rows, "doc_id long, rank long, text string"), "doc_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_ranks_of_many_rows_with_ties(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("score"))
    got = {r.doc_id: r["rank"] for r in retrieval.ranked(df.repartition(5), "doc_id").collect()}
    order = sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_search_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "...")], "doc_id long, text string")
    assert retrieval.bm25(df, "text", ["a"]).count() == retrieval.bm25(df.limit(0), "text", ["a"]).count() == 0


def test_links_in_all_quotes_and_references(spark):
    page = """<a href='/x'>a</a><A class=b href = /y>b</A><a href="/z?a=1&amp;b=2">c</a><a data-href="/no">d</a><!-- <a href="/no"> --><script>'<a href="/no">'</script><a href="/e&#233;">"""
    assert spark.createDataFrame([(page,)], "h string").select(web.hrefs(F.col("h"))).first()[0] == ["/x", "/y", "/z?a=1&b=2", "/eé"]
    text = "<p>&eacute;&#8217;&#x2014;&amp;#39;&nbsp;&unknown;&#0;&#xD800;&#1114112;</p>"
    assert spark.createDataFrame([(text,)], "h string").select(web.plain_text(F.col("h"))).first()[0] == "é’—&#39; &unknown;\ufffd\ufffd\ufffd"
    once = {"&amp;lt;": "&lt;", "&#38;lt;": "&lt;", "&lt;&amp;": "<&", "&&amp;;&copy": "&&;&copy", "&a&lt;;": "&a<;", "&middot;&amp;amp;": "·&amp;", "&Alpha;&quot;&nbsp;": 'Α" ', "": "", None: None}
    rows = spark.createDataFrame([(x,) for x in once], "t string").select("t", web.decoded(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == once


def test_a_kept_log_grows_by_batches(spark, tmp_path):
    at = str(tmp_path / "log")
    log = memory.saved(a_log(spark, WRITES), at)
    log = memory.append(log, at, memory.undo(log), "me", "2024-01-03")
    pick = lambda x: sorted((r.key, r.value, r.writer) for r in memory.state(x).collect())
    assert pick(log) == pick(memory.opened(log, at)) == [("a", 2.0, "me"), ("b", 5.0, "me")]
    again = memory.append(log, at, memory.rollback(log, "2024-01-02"), "you", "2024-01-03")
    assert pick(again) == [("a", 2.0, "you"), ("b", 6.0, "you")] and again.rows.count() == len(WRITES) + 3 + 2
    with pytest.raises(commits.Conflict, match="already exists"):
        memory.saved(log, at)


def test_eight_writers_at_once(spark, tmp_path):
    at, n = str(tmp_path / "log"), 8
    log = memory.saved(a_log(spark, WRITES), at)
    new = spark.createDataFrame([(f"k{i}", float(i)) for i in range(5)], "key string, value double")

    def write(i):
        for part in range(3):
            memory.append(log, at, new, f"writer{i}.{part}", "2024-02-01")

    with ThreadPoolExecutor(n) as pool:
        list(pool.map(write, range(n)))
    rows = memory.opened(log, at).rows.where("at = timestamp_ntz'2024-02-01'").collect()
    by = {}
    for r in rows:
        by.setdefault(r.seq, []).append((r.writer, r.key))
    assert sorted(by) == list(range(7, 7 + 3 * n)) and all(len(x) == 5 and len({w for w, _ in x}) == 1 for x in by.values())
    assert len({x[0][0] for x in by.values()}) == 3 * n
    before = {tuple(r) for r in memory.opened(log, at).rows.collect()}
    assert {tuple(r) for r in memory.compacted(log, at).rows.collect()} == before and len(commits.state(spark, at).batches) == 1
    assert {tuple(r) for r in memory.opened(log, at, 3 * n).rows.collect()} == before and memory.opened(log, at, 0).rows.count() == len(WRITES)


def test_a_number_is_taken_once(spark, tmp_path):
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda i: commits.placed(spark, f"{tmp_path}/c", "0", str(i)), range(64)))
    assert sum(won) == 1 and (tmp_path / "c" / "0").read_text() == str(won.index(True)) and os.listdir(tmp_path / "c") == ["0"]


def test_a_job_is_done_once_and_compaction_yields(spark, tmp_path):
    at = str(tmp_path / "log")
    log = memory.saved(a_log(spark, []), at)
    new = spark.createDataFrame([("a", 1.0)], "key string, value double")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: memory.append(log, at, new, "me", "2024-02-01", job="daily"), range(4)))
    assert memory.opened(log, at).rows.count() == 1
    memory.append(log, at, new, "me", "2024-02-02")
    names = tuple(commits.state(spark, at).batches)
    memory.compacted(log, at)
    with pytest.raises(commits.Conflict, match="replaced"):
        commits.committed(spark, at, "late", 9, names)


def test_parities_bound_the_difference_of_sets(spark):
    draw = random.Random(8)
    sets = [sorted({f"w{draw.randint(0, 400)}" for _ in range(n)}) for n in (0, 1, 5, 60, 300)]
    sets += [sorted({*s, "one more"}) for s in sets]
    rows = [list(r) for r in spark.createDataFrame([(s,) for s in sets], "words array<string>").coalesce(1).select(*retrieval.parities(F.col("words"))).collect()]
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    assert all(bits(a, b) <= len(set(s) ^ set(t)) for a, s in zip(rows, sets) for b, t in zip(rows, sets))
    assert all(bits(rows[i], rows[i + 5]) == 1 for i in range(5)) and bits(rows[3], rows[4]) > 90


def test_rows_of_a_batch_are_not_dealt_to_one_task(spark):
    at = lineage.place(spark, "log")
    log = memory.saved(a_log(spark, WRITES), at)
    log = memory.append(log, at, memory.undo(log), "me", "2024-01-03")
    plan = log.rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(batch" not in plan


def test_quota(spark):
    df = spark.createDataFrame([(i, 1, f"2024-01-0{1 + i}", "k") for i in range(4)], "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.over_quota for r in metering.running(df, "user_id", "ts", "event_id", 3).orderBy("event_id").collect()] == [False, False, False, True]


def test_pdf_text(spark, tmp_path):
    body = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj T* (second) Tj ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode /Length 9>> stream\n" + body + b"\nendstream endobj\n%%EOF")
    assert [r.text for r in pdf.read_pdfs(spark, str(tmp_path)).collect()] == ["Hello (you)\nsecond"]


@pytest.fixture
def site():
    """A web server on this machine, and how often each of its paths was asked for."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            status = {"/none": 404, "/busy": 503 if asked["/busy"] < 2 else 200, "/away": 302, "/local": 302}.get(self.path, 200)
            self.send_response(status)
            if status == 302:
                self.send_header("Location", "/p" if self.path == "/away" else "file:///etc/hostname")
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(b"x" * 5000 if self.path == "/long" else "<title>caf\u00e9</title><a href=/p>p</a>".encode("latin-1"))

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_pages_are_fetched(spark, site, tmp_path):
    at, asked = site
    (tmp_path / "p.html").write_text("<p>x</p>")
    urls = [f"{at}{p}" for p in ("/p", "/none", "/busy", "/away", "/local", "/long")] + [f"file://{tmp_path}/p.html", "http://127.0.0.1:1/", None]
    web_source.register(spark)
    named = spark.read.format("web").option("urls", " ".join(u for u in urls if u)).option("retries", 1).option("maxBytes", 4000).load()
    table = web_source.fetched(spark.createDataFrame([(u,) for u in urls * 2], "url string"), tasks=4, how=web_source.Fetch(retries=1, max_bytes=4000))
    for df in (named, table):
        asked.clear()
        found = {r.url: r for r in df.collect()}
        assert set(found) - {None} == set(urls) - {None} and asked["/busy"] == 2 and asked["/none"] == 1
        good = {u for u, r in found.items() if r.error is None}
        assert good == {f"{at}/p", f"{at}/busy", f"{at}/away"} and all("café" in found[u].html and found[u].status == 200 for u in good)
        assert found[f"{at}/none"].status == 404 and all(r.html is None for u, r in found.items() if u not in good)
    held = table.where("html is not null").select(F.monotonically_increasing_id().alias("page_id"), "url", "html")
    assert {r.title for r in pages.read_pages(held).collect()} == {"café"} and pages.links(held).where(F.col("target").endswith("/p")).count() == 3


def test_stream_over_several_batches(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet")
    df.repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = reference.drained(monitors.running_counts(stream, ["user_id"], "value"), "complete")
    last = got.groupBy("user_id").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, df.groupBy("user_id").count().collect()))


def test_streams_leave_results_in_the_shared_folder(spark):
    rows = reference.stream_totals(spark, SF)
    assert rows.count() and rows.inputFiles() and all(lineage.shared_dir(spark).split(":")[-1].strip("/") + "/stream-" in x for x in rows.inputFiles())


@pytest.mark.parametrize("per_batch, fold", [(1, 32), (1, 2), (9, 32)])
def test_changes_of_a_hot_key_over_batches(spark, tmp_path, monkeypatch, per_batch, fold):
    monkeypatch.setattr(monitors, "FOLD", fold)
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 5}", None if i % 7 == 0 else str(i // 4 % 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, key string, content string")
    for lo in range(0, 3000, 1000):
        df.where(f"seq >= {lo} and seq < {lo + 1000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    want = {}
    for _, key, content in rows:
        last, n, changed = want.get(key, (content, 0, 0))
        want[key] = content, n + 1, changed + (last is not None and content is not None and last != content)
    at = lineage.place(spark, "changes")
    count = lambda: {r.key: (r.looks, r.changed) for r in monitors.change_counts(stream, ["key"], "seq", F.col("content"), at).collect()}
    assert count() == {k: x[1:] for k, x in want.items()}
    # the last batch runs again, as after a crash that came before its commit; and so it goes on from there
    if per_batch == 1:
        done = os.path.join(at.removeprefix("file://").replace("file:", ""), "state", "commits")
        for name in ("2", ".2.crc"):
            if os.path.exists(os.path.join(done, name)):
                os.unlink(os.path.join(done, name))
        assert count() == {k: x[1:] for k, x in want.items()}
    df.where("seq < 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sum(n for n, _ in count().values()) == 3500


def test_a_key_of_a_batch_goes_to_many_tasks(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("key"), F.col("id").alias("seq"), F.col("id").cast("string").alias("digest"))
    r = monitors.batch_changes(df, ["key"]).first()
    assert (r.looks, r.changed, r.first, r.last) == (100_000, 99_999, "0", "99999")
