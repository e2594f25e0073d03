"""Web pages: text, titles, links, site maps and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..plans.lineage import cut


def read_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", web.title(F.col("html")).alias("title"), web.plain_text(F.col("html")).alias("text"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, source and target (both canonical) of every link of every page, in page order."""
    found = pages.select("page_id", "url", F.posexplode(web.hrefs(F.col("html"))).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), web.canonical(F.col("url")).alias("source"), web.canonical(web.resolved(F.col("url"), F.col("href"))).alias("target"))


def site_map(pages: DataFrame) -> DataFrame:
    """For each host its pages, distinct paths and canonical URLs."""
    url = F.col("url")
    return pages.groupBy(web.host(url).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(web.path(url)).alias("paths"), F.count_distinct(web.canonical(url)).alias("urls"))


def crawl(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """url and depth of all that can be reached from seeds (url) over edges (source, target) in at most depth steps, the least depth of each.

    A step joins the newest URLs with the edges and drops those seen before, so each URL is followed once.
    """
    new = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0).cast("long")))
    seen = new
    for step in range(1, depth + 1):
        found = new.join(edges, new["url"] == edges["source"]).select(F.col("target").alias("url")).distinct()
        new = cut(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(step).cast("long")))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


def fetched(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The stored pages for a table of URLs (url), by canonical form: asked, page_id, url; page_id is null where there is none."""
    asked = urls.select(F.col("url").alias("asked"), web.canonical(F.col("url")).alias("canonical"))
    have = pages.groupBy(web.canonical(F.col("url")).alias("canonical")).agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("page"))
    return asked.join(have, "canonical", "left").select("asked", "page.page_id", "page.url")
