"""Pages that are fetched in rounds by a stream, from a server on this machine."""

from __future__ import annotations

import os
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

from tidemark.plans.lineage import place
from tidemark.sources import rounds
from tidemark.streaming import watch


@pytest.fixture
def site():
    asked, says = Counter(), {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            body = says.get(self.path)
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, says
    server.shutdown()


def stream(spark, **options):
    rounds.register(spark)
    return spark.readStream.format("web_rounds").options(retries=0, tasks=3, **options).load()


def next_round(every):
    time.sleep(every - time.time() % every + 0.05)


def test_rounds_restart_and_run_again(spark, site, tmp_path):
    at, asked, says = site
    says |= {f"/{i}": "first" for i in range(20)}
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "a.txt").write_text("\n".join(f"{at}/{i}" for i in range(15)) + "\n\n")
    (tmp_path / "list" / "b.txt").write_text("\r\n".join(f"{at}/{i}" for i in range(10, 21)))
    every, done = 8, f"file://{tmp_path}/done"
    run = lambda: watch.ran(stream(spark, list=f"file://{tmp_path}/list", every=every), done)
    next_round(every)
    got = run()
    assert got.count() == 21 and got.select("round").distinct().count() == 1
    assert {(r.url, r.status, r.html) for r in got.collect()} == {(f"{at}/{i}", 200, "first") for i in range(20)} | {(f"{at}/20", 404, None)}
    assert set(asked.values()) == {1}  # two lists have some URLs both
    # a crash before the commit of the batch: it is run again with the same offsets, the sink has its rows already
    commits = tmp_path / "done" / "checkpoint" / "commits"
    for name in os.listdir(commits):
        (commits / name).unlink()
    assert run().groupBy("round").count().where("count <> 21").count() == 0
    # a restart in a later round sees what has changed
    says["/3"] = "second"
    next_round(every)
    got = run()
    assert got.groupBy("round", "url").count().where("count > 1").count() == 0
    last = got.agg(F.max("round")).first()[0]
    assert {r.html for r in got.where((F.col("round") == last) & F.col("url").endswith("/3")).collect()} == {"second"} and got.where(F.col("round") == last).count() == 21


def test_pages_are_watched_over_rounds(spark, site):
    at, _, says = site
    says |= {"/a": "one", "/b": "one"}
    every, done = 6, place(spark, "watch")
    run = lambda: watch.ran(watch.watched(stream(spark, urls=f"{at}/a {at}/b {at}/a", every=every), ["url"], "at", "round", F.col("html"), "1 day"), done)
    next_round(every)
    run()
    says["/b"] = "two"
    next_round(every)
    found = run().collect()
    seen = {u: [r.found for r in sorted(found, key=lambda r: r.seq) if r.url.endswith(u)] for u in ("/a", "/b")}
    assert seen["/a"][0] == seen["/b"][0] == "new" and set(seen["/a"][1:]) == {"same"} and seen["/b"][1:].count("changed") == 1


def test_no_urls_and_wrong_options(spark, tmp_path):
    assert watch.ran(stream(spark, every=3600), place(spark, "watch")).count() == 0
    with pytest.raises(ValueError, match="more than 0 seconds"):
        rounds.RoundsReader({"every": "0"})
    reader = rounds.RoundsReader({"urls": "http://a.org"})
    assert reader.partitions({"round": 5}, {"round": 5}) == [] and [p.round for p in reader.partitions({"round": 5}, {"round": 9})] == [9] * 8
