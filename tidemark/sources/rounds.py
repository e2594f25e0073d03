"""A stream of pages that are looked at again and again: spark.readStream.format("web_rounds").option("urls", "https://a.org https://a.org/b").option("every", "3600").load().

Time is cut into rounds of ``every`` seconds, and an offset is the number of a round. A batch fetches each URL once, in the last round that it has, as a page of an earlier one can't be had any
more. So a stream that was stopped goes on with the round that it is in, one that is run again within a round fetches nothing, and a batch that is run again after a crash has the
same round and the same rows but for what the pages say by then; a sink that writes each batch once, such as files, has each URL once a round.

Rows are url, status, html and error as ``web`` gives them, with round and at, the time of the fetch. URLs come from option urls (white space between them) or, where there are many, from
option list: a folder of text files with a URL a line, on a file system that pyarrow opens. Each of tasks reads the list and fetches its own share by a hash.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .web import SCHEMA, Fetch


class Share(InputPartition):
    """What a task fetches: the URLs of a share, in a round."""

    def __init__(self, share: int, of: int, round: int):
        self.share, self.of, self.round = share, of, round


class RoundsReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.named, self.list = options.get("urls", "").split(), options.get("list")
        self.every, self.tasks = float(options.get("every", "3600")), int(options.get("tasks", "8"))
        self.how = Fetch(float(options.get("timeout", "20")), int(options.get("retries", "2")), max_bytes=int(options.get("maxBytes", str(32 << 20))))
        if not self.every > 0:
            raise ValueError("a round takes more than 0 seconds")

    def _round(self) -> int:
        return int(time.time() // self.every)

    def initialOffset(self) -> dict:
        return {"round": self._round() - 1}

    def latestOffset(self) -> dict:
        return {"round": self._round()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["round"] <= start["round"]:
            return []
        return [Share(i, self.tasks, end["round"]) for i in range(self.tasks)]

    def _urls(self) -> Iterator[str]:
        yield from self.named
        if self.list:
            at, path = fs.FileSystem.from_uri(self.list)
            for info in at.get_file_info(fs.FileSelector(path, recursive=True)):
                if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                    with at.open_input_stream(info.path) as f:
                        yield from _lines(f)

    def read(self, partition: Share) -> Iterator[tuple]:
        seen = set()  # of the share, so that a URL that is listed twice is fetched once
        for url in self._urls():
            if zlib.crc32(url.encode()) % partition.of == partition.share and url not in seen:
                seen.add(url)
                yield (*self.how.page(url), partition.round, datetime.now(timezone.utc).replace(tzinfo=None))

    def commit(self, end: dict) -> None:
        pass


def _lines(f: pa.NativeFile) -> Iterator[str]:
    """The lines of a file that are not blank, a piece of it in memory at a time."""
    rest = b""
    while piece := f.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x for x in (y.decode("utf-8", "replace").strip() for y in whole) if x)
    if last := rest.decode("utf-8", "replace").strip():
        yield last


class RoundsSource(DataSource):
    """Pages by rounds; options urls or list, every (seconds), tasks, timeout, retries and maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "web_rounds"

    def schema(self) -> str:
        return f"{SCHEMA}, round long, at timestamp_ntz"

    def streamReader(self, schema) -> RoundsReader:
        return RoundsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RoundsSource)
