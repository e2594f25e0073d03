"""A data source that fetches URLs: spark.read.format("web").option("urls", "https://a.org https://a.org/b").load().

For a table of URLs that doesn't fit in an option there is ``fetched``, which fetches them in the tasks that have them.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, html string, error string"
SCHEMES = ("http", "https")


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Follows no redirect to another scheme than those of the web."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if urlsplit(newurl).scheme.lower() not in SCHEMES:
            raise urllib.error.URLError("redirected to another scheme than http and https")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


@dataclass(frozen=True)
class Fetch:
    """How pages are fetched: seconds to wait for an answer, further attempts after a fault of the server or of the network, and bytes of the longest page."""

    timeout: float = 20.0
    retries: int = 2
    pause: float = 0.5
    max_bytes: int = 32 << 20

    def page(self, url: str | None) -> tuple[str | None, int | None, str | None, str | None]:
        """url, status, html and error. A page that can't be had, or is longer than max_bytes, is a row that says so; none is cut."""
        if not url or urlsplit(url).scheme.lower() not in SCHEMES:
            return url, None, None, "only http and https are fetched"
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.pause * 2 ** (attempt - 1))
            try:
                with urllib.request.build_opener(_Redirects).open(url, timeout=self.timeout) as r:
                    body = r.read(self.max_bytes + 1)
                    if len(body) > self.max_bytes:
                        return url, r.status, None, f"longer than {self.max_bytes} bytes"
                    return url, r.status, _decoded(body, r.headers.get_content_charset()), None
            except urllib.error.HTTPError as e:
                found = url, e.code, None, str(e)[:200]
                if e.code < 500 and e.code != 429:
                    return found
            except Exception as e:  # noqa: BLE001  whatever keeps a page from being had becomes a row
                found = url, None, None, str(e)[:200]
        return found


def _decoded(body: bytes, charset: str | None) -> str:
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:  # a name that no one knows
        return body.decode("utf-8", "replace")


def fetched(urls: DataFrame, url: str = "url", tasks: int = 64, how: Fetch = Fetch()) -> DataFrame:
    """A row of SCHEMA for each distinct URL of a table, fetched in tasks to which URLs are dealt by a hash, so that a host with most of them is spread too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(how.page(x), (pa.string(), pa.int32(), pa.string(), pa.string()))], ["url", "status", "html", "error"])

    return urls.select(F.col(url).cast("string").alias("url")).distinct().repartition(tasks, "url").mapInArrow(run, SCHEMA)


class UrlPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.tasks = int(options.get("tasks", "8"))
        self.how = Fetch(float(options.get("timeout", "20")), int(options.get("retries", "2")), max_bytes=int(options.get("maxBytes", str(32 << 20))))

    def partitions(self) -> list[InputPartition]:
        return [UrlPartition(self.urls[i :: self.tasks]) for i in range(min(self.tasks, len(self.urls)) or 1)]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        return map(self.how.page, partition.urls)


class WebSource(DataSource):
    """Rows of url, status, html and error for the http and https URLs in option urls (white space between them); options tasks, timeout, retries and maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)
