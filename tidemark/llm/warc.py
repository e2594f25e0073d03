"""WARC archives of pages: range-sorted, sharded, the same bytes on every run.

Shards are ranges of the key and a hash of the payload, cut where the bytes of all records before reach a multiple of ``SHARD_BYTES``, so they depend on the
data alone and neither far-off keys nor a key with many payloads make a large one. A shard is written in order of its keys; a file is closed when its compressed size reaches ``FILE_BYTES``. All
headers and digests are made anew from the payload. Of equal payloads the one with the smallest key is a response and the
others are revisits of it. Files get temporary names until they are whole; the manifest, written last, names what belongs to the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store
from .tables import place, shuffles, stored, table

SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "shard int, file int, name string, records long, bytes long, crc long"
RECORDS = "name string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'tidemark:' + ':'.join(map(str, key)))}>"


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(6, wbits=31)
    return c.compress(data) + c.flush()


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member of its own; headers that are None are left out."""
    full = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in full if v is not None) + "\r\n"
    return _gz(head.encode() + block + b"\r\n\r\n")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", _urn("page", page_id, url, digest, revisit)),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", page_id),
        ("X-Page-Url", None if url is None else quote(url, safe="")),
        ("X-Payload-Length", len(payload)),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", refers_to)]
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def info_record(name: str) -> bytes:
    return record("warcinfo", [("WARC-Record-ID", _urn("file", name)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _cuts(rows: DataFrame) -> list[tuple[bool, int, int]]:
    """The first key (page_id is not null, page_id, tie) of each shard. The driver sees a sum a partition and a row a shard."""
    spark = rows.sparkSession
    order = [F.col("page_id").asc_nulls_first(), "tie"]
    keys = rows.groupBy("page_id", "tie").agg(F.sum(F.octet_length("html").cast("long") + 512).alias("bytes"))
    keys = stored(keys.repartitionByRange(shuffles(spark), *order).withColumn("part", F.spark_partition_id()), "warc-keys")
    before, offsets = 0, []
    for r in keys.groupBy("part").agg(F.sum("bytes").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    if not offsets:
        return []
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy(*order)) - F.col("bytes")
    placed = keys.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")  # a row a partition
    shard = F.floor((F.col("before") + running) / SHARD_BYTES)
    first = F.min(F.struct(F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "tie"))
    return sorted(tuple(r["first"]) for r in placed.withColumn("shard", shard).groupBy("shard").agg(first.alias("first")).collect())


def write(pages: DataFrame, uri: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes an archive of pages in the folder uri and returns its manifest (uri/manifest).

    Null html counts as empty, a null url has no header, null keys come first and never are what others refer to
    unless all equal payloads have one. Payloads of less than min_bytes are always responses. Rows that repeat in
    key and payload give one response and revisits of the same key. Other columns are not written. An empty table gives no files and an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("tie", F.xxhash64("html"))
    digests = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "tie", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"))
    digests = stored(digests, "digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = stored(firsts, "firsts")  # so that Spark can split the rows of a digest that many pages have
    notes = digests.join(firsts, "digest").select("page_id", "tie", F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), F.lit(0).alias("kind"), "digest", "first_id").distinct()
    both = rows.select("page_id", "tie", "url", "html", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("first_id")).unionByName(notes)
    cuts = _cuts(rows)
    tops = np.array([(x[0], x[1], x[2]) for x in cuts[1:]], [("known", bool), ("page_id", np.int64), ("tie", np.int64)])

    def sharded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.empty(b.num_rows, tops.dtype)
            key["known"], key["page_id"], key["tie"] = (b.column(0).is_valid().to_numpy(zero_copy_only=False), b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(tops, key, "right").astype(np.int32))], [*b.schema.names, "shard"])

    both = both.mapInArrow(sharded, StructType(list(both.schema)).add("shard", "integer"))
    dealt = both.repartitionByRange(max(1, len(cuts)), "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "html").drop("tie")
    store.make_dir(uri)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, parts, size, records = None, 0, [], 0, 0
        key, first, seen = object(), {}, set()  # of the key that is being written

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal file, parts, size, records
            if records:
                name = f"part-{shard:06d}-{file:06d}.warc.gz"
                content = info_record(name) + b"".join(parts)
                store.commit(uri, name, content)
                row = [shard, file, name, records, len(content), zlib.crc32(content)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3))], ["shard", "file", "name", "records", "bytes", "crc"])
            file, parts, size, records = file + 1, [], 0, 0

        for b in batches:
            at = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                now, page, kind = at["shard"][i].as_py(), at["page_id"][i].as_py(), at["kind"][i].as_py()
                if now != shard:
                    yield from flush()
                    shard, file = now, 0
                if (now, page) != key:
                    key, first, seen = (now, page), {}, set()
                if kind == 0:
                    first[at["digest"][i].as_py()] = at["first_id"][i].as_py()
                    continue
                payload = at["html"][i].as_py().encode()
                digest = hashlib.sha1(payload).digest()
                revisit = digest in first and (first[digest] != page or digest in seen)
                seen.add(digest)
                parts.append(page_record(page, at["url"][i].as_py(), payload, first.get(digest), revisit))
                size, records = size + len(parts[-1]), records + 1
                if size >= FILE_BYTES:
                    yield from flush()
        yield from flush()

    found = place(spark, "warc-files")
    dealt.mapInArrow(run, FILES).write.parquet(found)
    spark.read.schema(FILES).parquet(found).coalesce(1).write.parquet(f"{uri}/manifest")  # a row per file
    return manifest(spark, uri)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{uri}/manifest")


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    view, at = memoryview(content), 0
    while at < len(view):
        d, parts = zlib.decompressobj(wbits=31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a record breaks off")
            part = view[at : at + step]
            parts.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> dict[str, object]:
    """Headers in lower case, and block and payload; the digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    out: dict[str, object] = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(out["content-length"])]
    if out["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("a block differs from its digest")
    out |= {"block": block, "payload": block.partition(b"\r\n\r\n")[2]}
    if out["warc-type"] == "response" and out["warc-payload-digest"] != f"sha1:{base32_sha1(out['payload'])}":
        raise ValueError("a payload differs from its digest")
    return out


def read(spark: SparkSession, uri: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of the records in the files that the manifest lists.

    payload is null for revisits, and for all without payloads.
    """
    from urllib.parse import unquote

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(uri)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    whole = manifest(spark, uri).select("name", "crc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                number = lambda x: None if x is None else int(x)
                content = content.as_buffer().to_pybytes()
                crc = zlib.crc32(content)
                for m in members(content):
                    r = parsed(m)
                    if r["warc-type"] == "warcinfo":
                        continue
                    response = r["warc-type"] == "response"
                    rows.append((name, crc, number(r.get("x-page-id")), None if "x-page-url" not in r else unquote(r["x-page-url"]), len(r["payload"]) if response else int(r["x-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], number(r.get("x-refers-to-page-id")), r["payload"] if payloads and response else None))
                    held += len(r["payload"])
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    got = files.mapInArrow(run, RECORDS.replace("name string", "name string, file_crc long")).join(whole, "name")
    sound = F.when(F.col("file_crc") == F.col("crc"), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("damaged archive "), F.col("name"))).cast("long"))
    out = got.select(sound.alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return out if payloads else out.drop("payload")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "file_crc", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages, read back."""
    uri = place(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), uri)
    return read(spark, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
