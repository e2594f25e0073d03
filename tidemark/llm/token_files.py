"""Token ids of texts in files of fixed-width packed bits.

A file holds whole documents in ascending order of their ids:

    8 bytes   b"TIDEIDS1"
    8 bytes   length of the header, little endian
    header    JSON: bits, block (ids in a block), docs, ids, shard, file
    docs x 8  document ids; docs x 1  1 where the id is null; docs x 8  numbers of ids
    (blocks + 1) x 8  byte offsets of the blocks in what follows
    blocks    ids, each in the fewest bits that hold the vocabulary, low bits first; a block starts on a byte

Any id is read from its block's offset alone, and blocks are unpacked by numpy at once.
Files are written under temporary names and renamed; a manifest, written last, lists them with their places in the
whole sequence, and readers take what it lists only.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, words
from .tables import place, table

MAGIC = b"TIDEIDS1"
BLOCK = 4096
FILE_IDS = 4 << 20
SHARD_BYTES = 24 << 20
#: Distinct words that a worker remembers the ids of; beyond this it forgets all and goes on.
REMEMBERED = 400_000

FILES = "shard int, file int, name string, docs long, ids long, bytes long, crc long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return np.ascontiguousarray(raw[:, : bits // 8]).tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = data[: n * bits // 8].reshape(n, bits // 8)
    elif n:
        flags = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").ravel()


def to_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, shard: int, file: int, block: int = BLOCK) -> bytes:
    parts = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    head = json.dumps({"bits": bits, "block": block, "docs": len(doc_ids), "ids": len(ids), "shard": shard, "file": file}).encode()
    return b"".join((
        MAGIC, np.array([len(head)], "<u8").tobytes(), head,
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.asarray(lengths, "<u8").tobytes(),
        np.cumsum([0, *map(len, parts)]).astype("<u8").tobytes(), *parts,
    ))


class TokenFile:
    """A file's content; ids(a, b) unpacks only the blocks that hold ids a .. b - 1."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(content, "<u8", 1, 8)[0])
        self.head = json.loads(content[16 : 16 + n])
        at, docs = 16 + n, self.head["docs"]
        self.doc_ids = [None if gone else x for x, gone in zip(np.frombuffer(content, "<i8", docs, at).tolist(), np.frombuffer(content, np.uint8, docs, at + 8 * docs).tolist())]
        at += 9 * docs
        self.lengths = np.frombuffer(content, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        blocks = -(-self.head["ids"] // self.head["block"])
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        self.data = np.frombuffer(content, np.uint8, int(self.offsets[-1]), at + 8 * (blocks + 1))

    def ids(self, a: int, b: int) -> np.ndarray:
        block, n = self.head["block"], self.head["ids"]
        out = [unpack(self.data[self.offsets[k] : self.offsets[k + 1]], min(block, n - k * block), self.head["bits"]) for k in range(a // block, -(-b // block))]
        return np.concatenate(out)[a - a // block * block :][: b - a] if out else np.zeros(0, np.uint32)


class _Codes(dict):
    """Numbers words in the order in which they are met; new holds those that came since it was emptied."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


#: Lower-case letters that the tokenizer's normalizer and splitter leave alone: a-z, and those of U+00DF to U+00FF in UTF-8.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: A full stop or comma at the end of a word is a piece of its own; words are remembered without it.
STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \t\n\r\x0b\x0c]|\Z)")


class WordEncoder:
    """Ids of texts by way of ids of words.

    For tokenizers that fold case, and never let a token span white space or letters and other characters: a text's ids are those of
    its words one after the other. The library encodes a word once; it is then remembered. Words of PLAIN letters go straight to the
    tokenizer's model, as the steps before it would not change or split them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.codes, self.starts, self.flat = _Codes(), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, step: int = 20_000) -> None:
        new, self.codes.new = self.codes.new, []
        for a in range(0, len(new), step):
            part, lists, others = new[a : a + step], [], []
            for i, w in enumerate(part):
                if PLAIN.fullmatch(w):
                    lists.append([t.id for t in self.model.tokenize(w.decode().translate(self.letters))])
                else:
                    lists.append(None)
                    others.append(i)
            for i, e in zip(others, self.tokenizer.encode_batch_fast([part[i].decode() for i in others], add_special_tokens=False)):
                lists[i] = e.ids
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
            self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))))

    def encode(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each followed by end_id, and their numbers."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        split = [x.split() if b"<|" in x else STOP.sub(rb" \1", x.lower()).split() for x in texts]  # special tokens keep their case
        n = np.fromiter(map(len, split), np.int64, len(split))
        code = np.fromiter(map(self.codes.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))
        self._learn()
        size = self.starts[code + 1] - self.starts[code]
        word_end = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        lengths = word_end[np.cumsum(n)] - word_end[np.cumsum(n) - n] + 1
        ids = np.full(int(lengths.sum()), end_id, np.uint32)
        at = np.repeat(self.starts[code] - word_end[:-1], size) + np.arange(int(size.sum()))
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(lengths) - 1] = False
        ids[inside] = self.flat[at]
        return ids, lengths


_encoders: dict[str, WordEncoder] = {}


def write(docs: DataFrame, uri: str, tokenizer_path: str, vocabulary: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to token files in the folder uri and returns the manifest, which is in uri/manifest.

    Null texts count as empty and give the end id alone. Null ids come first; rows that repeat
    are written as often as they come; ties on the id are in the order of a hash of the text. An empty table gives an empty manifest.
    uri is anything that pyarrow.fs opens on all executors.
    """
    spark, bits = docs.sparkSession, max(1, int(vocabulary - 1).bit_length())
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1))).first()
    shards = max(1, -(-((total[0] or 0) + 16 * total[1]) // SHARD_BYTES))
    key = F.xxhash64("text")
    dealt = rows.withColumn("tie", key).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    store.make_dir(uri)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        shard, file, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal file, waiting, held
            names, lengths, ids = [x for w in waiting for x in w[0]], np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
            content = to_file(names, lengths, ids, bits, shard, file)
            name = f"part-{shard:06d}-{file:06d}.ids"
            store.commit(uri, name, content)
            row = [shard, file, name, len(names), len(ids), len(content), zlib.crc32(content)]
            file, waiting, held = file + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4))], ["shard", "file", "name", "docs", "ids", "bytes", "crc"])

        for b in batches:
            names = b.column(0).to_pylist()
            for g in words.byte_groups(b.column(1)):
                ids, lengths = encoder.encode(g.data, g.bounds, end_id)
                waiting.append((names[g.first : g.first + g.n_docs], lengths, ids))
                held += len(ids)
                if held >= FILE_IDS:
                    yield flush()
        if waiting:
            yield flush()
        words.release()

    found = place(spark, "token-files")
    dealt.mapInArrow(run, FILES).write.parquet(found)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    spark.read.schema(FILES).parquet(found).withColumn("start", before).coalesce(1).write.parquet(f"{uri}/manifest")  # a row per file
    return manifest(spark, uri)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(f"{FILES}, start long").parquet(f"{uri}/manifest")


def read(spark: SparkSession, uri: str, digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with digest, what it makes of them) of each document in the files that the manifest lists."""
    listed = manifest(spark, uri)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(uri)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    schema = f"name string, size long, crc long, doc_id long, at long, n_tokens long, {'digest long' if digest else 'ids array<int>'}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                content = content.as_buffer().to_pybytes()
                f, crc = TokenFile(content), zlib.crc32(content)
                ids, ends = f.ids(0, f.head["ids"]), np.cumsum(f.lengths)
                n, each = len(ends), [ids[b - k : b] for b, k in zip(ends.tolist(), f.lengths.tolist())]
                last = pa.array([digest(x) for x in each], pa.int64()) if digest else pa.array(each, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([len(content)] * n, pa.int64()), pa.array([crc] * n, pa.int64()), pa.array(f.doc_ids, pa.int64()), pa.array(ends - f.lengths, pa.int64()), pa.array(f.lengths, pa.int64()), last],
                    ["name", "size", "crc", "doc_id", "at", "n_tokens", "digest" if digest else "ids"],
                )

    got = files.mapInArrow(run, schema)
    whole = listed.select(F.col("name"), F.col("bytes"), F.col("crc").alias("listed_crc"), "start")
    joined = got.join(whole, "name")
    sound = F.when((F.col("size") == F.col("bytes")) & (F.col("crc") == F.col("listed_crc")), F.col("start") + F.col("at")).otherwise(F.raise_error(F.concat(F.lit("damaged token file "), F.col("name"))).cast("long"))
    return joined.select("doc_id", sound.alias("start"), "n_tokens", "digest" if digest else "ids")


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def tokenized(docs: DataFrame) -> DataFrame:
    """Writes docs with the public 49k vocabulary and end id 2, and returns start, n_tokens and ids_crc32 of each as read back."""
    import public_tokenizers

    uri = place(docs.sparkSession, "tokens")
    write(docs, uri, public_tokenizers.path("word_bpe_49k.json"), 49408, 2)
    return read(docs.sparkSession, uri, crc_of_ids).withColumnRenamed("digest", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in packed files, read back."""
    return tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"))
