"""Search by an inverted index that is kept in the shared folder: built once, and of it a search reads its own terms' lists only.

Units (documents, passages) get dense numbers. A term's list is cut into blocks of ``BLOCK`` units in order of their numbers: gaps between numbers, counts, lengths and
gaps between places, each as bytes of variable length, and the highest score that any unit of the block can get by the term (without the term's weight).
Blocks are made by bucket and ``PIECE`` units and sorted by term and number within, so a frequent term of many units is written, and read, by several tasks. Buckets are folders: a search skips those of
other terms, within a file it skips row groups by their terms, and it doesn't read columns that it has no use for, such as places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.lineage import stored
from .retrieval import B, K1, top

BLOCK, BUCKETS = 128, 64
#: Units of a span, within which a search bounds scores.
SPAN = 1024
#: Highest blocks that are read first, as a multiple of the results asked for.
FIRST = 4
#: Bytes of the places of a block, one unit's beyond that, so blocks of long texts have fewer units.
PLACES = 1 << 13
#: Bytes of a row group: rows of other terms in the same file are skipped by these.
ROW_GROUP = 1 << 20
#: Words of whole texts (one at least), and blocks, that a task has in numpy at a time, however many a batch brings.
WORDS, AT_ONCE = 1 << 18, 256
#: Bytes of a batch that goes to Python while an index is built (a row at least). Rows alone (10,000) bound nothing, as texts and runs have any length.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 24
#: Postings of a term that go to the sort as one row, and postings that a task makes blocks of at a time.
RUN, POSTINGS = 512, 1 << 16
#: Units whose postings of a bucket go to one task. Ranges of terms would have to be sampled, so all postings would be made twice.
PIECE = 1 << 22


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (not negative) as bytes, seven bits in each, low ones first, and where each value ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k) if k < 9 else values >> np.uint64(63) > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        part = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[(ends - sizes)[has] + k] = part | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unvarints(data: np.ndarray) -> np.ndarray:
    """The values of such bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 128
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


@dataclass(frozen=True)
class Index:
    """units: number, length and the columns that were kept; blocks of the lists; how many units there are and their mean length."""

    units: DataFrame
    blocks: DataFrame
    count: int
    mean: float


def _numbered(units: DataFrame, text: str) -> DataFrame:
    """units with dense numbers from 0, in the order of their files; what a task has before it comes from a row a task."""
    rows = units.withColumn("words", tokens(F.col(text))).drop(text).withColumn("length", F.size("words").cast("long")).withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("task", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "words")
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", before.alias("before"))
    return rows.join(F.broadcast(tasks), "task").withColumn("number", F.col("before") + F.col("at")).drop("task", "at", "before")


def _binary(data: np.ndarray, upto: np.ndarray) -> pa.Array:
    """Binary values that follow each other in data, cut at upto."""
    return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data)])


def _cut(values: np.ndarray, upto: np.ndarray) -> pa.Array:
    """Values as bytes, cut at upto."""
    data, ends = varints(values)
    return _binary(data, np.append(0, ends)[upto])


def _starts(new: np.ndarray, size: int) -> np.ndarray:
    """Where pieces of up to size start, if runs start at new."""
    runs = np.flatnonzero(new)
    return np.flatnonzero((np.arange(len(new)) - np.repeat(runs, np.diff(np.append(runs, len(new))))) % size == 0)


RUNS = ["term", "first", "n", "numbers", "counts", "lengths", "places"]


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column."""
    upto = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]


def _numbers(gaps: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers from their gaps in pieces of n, which start at first."""
    up = np.cumsum(gaps)
    return up - np.repeat(up[np.cumsum(n) - n], n) + np.repeat(first, n)


def _unpacked(b: pa.RecordBatch) -> pa.Table:
    """bucket, term, number, times, length and places of each posting in runs."""
    n = b.column("n").to_numpy()
    gaps, times, length = (unvarints(_bytes(b.column(c))) for c in ("numbers", "counts", "lengths"))
    data = _bytes(b.column("places"))
    ends = (np.flatnonzero(data < 128) + 1)[np.cumsum(times) - 1]
    of = pa.array(np.repeat(np.arange(len(b)), n))
    arrays = [b.column("bucket").take(of), b.column("term").take(of), pa.array(_numbers(gaps, b.column("first").to_numpy(), n)), pa.array(times), pa.array(length), _binary(data, np.append(0, ends))]
    return pa.Table.from_arrays(arrays, ["bucket", "term", "number", "times", "length", "places"])


def _postings(rows: DataFrame) -> DataFrame:
    """The postings of each term in rows (number, length, words): term and first number, and, as bytes of up to RUN postings, gaps of numbers, counts, lengths and gaps of places.

    A run is of rows whose numbers follow each other, so runs of a term don't overlap and a sort by their first numbers puts its postings in order.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = b.column(2).offsets.to_numpy()
            jumps = np.append(np.flatnonzero(np.diff(b.column(0).to_numpy()) != 1) + 1, len(b))  # where another file begins
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + WORDS, "right")) - 1)
                j = min(j, int(jumps[np.searchsorted(jumps, i, "right")]))
                if upto[j] > upto[i]:
                    yield some(b.slice(i, j - i))
                i = j

    def some(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(b)), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # rows and places are in order as they are
        order = np.argsort(row * len(coded.dictionary) + code, kind="stable")
        code, row, place = code[order], row[order], place[order]
        new = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1]))))
        times = np.diff(np.append(new, len(code)))
        gaps = np.diff(place, prepend=0)
        gaps[new] = place[new]
        number, length = (b.column(i).to_numpy()[row[new]] for i in (0, 1))
        # by term, then by number
        code = code[new]
        order = np.argsort(code, kind="stable")
        data, ends = varints(gaps)
        upto = np.append(0, ends[np.append(new[1:], len(place)) - 1])
        sizes = np.diff(upto)[order]
        data = data[np.repeat(upto[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))]
        code, number, length, times = code[order], number[order], length[order], times[order]
        starts = _starts(np.concatenate(([True], code[1:] != code[:-1])), RUN)
        cuts = np.append(starts, len(code))
        steps = np.diff(number, prepend=0)
        steps[starts] = 0
        terms = coded.dictionary.take(pa.array(code[starts]))
        return pa.RecordBatch.from_arrays([terms, pa.array(number[starts]), pa.array(np.diff(cuts)), *(_cut(x, cuts) for x in (steps, times, length)), _binary(data, np.append(0, np.cumsum(sizes))[cuts])], RUNS)

    return rows.select("number", "length", "words").mapInArrow(run, "term string, first long, n long, numbers binary, counts binary, lengths binary, places binary")


def _blocks(postings: DataFrame, mean: float) -> DataFrame:
    """Blocks of runs of postings that are sorted by bucket, term and first number."""
    schema = "bucket int, term string, first long, last long, n int, most double, numbers binary, counts binary, lengths binary, places binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(t: pa.Table, whole: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """Blocks of all rows, but for the last block unless whole; and the rows that are left."""
        t = t.combine_chunks()
        terms = t.column("term").chunk(0) if t.num_rows else pa.array([], pa.string())
        if not len(terms):
            return None, t
        new = np.concatenate(([True], pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False))) if len(terms) > 1 else np.ones(1, bool)
        number, times, length = (t.column(c).to_numpy() for c in ("number", "times", "length"))
        places = t.column("places").chunk(0)
        offsets = np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(places) + 1]
        new[1:] |= np.diff((offsets[1:] - offsets[0]) // PLACES) > 0
        starts = _starts(new, BLOCK)
        kept = len(starts) if whole else len(starts) - 1
        stop = len(new) if whole else int(starts[-1])
        rest = t.slice(stop)
        if not kept:
            return None, rest
        starts = starts[:kept]
        ends = np.append(starts[1:], stop)
        gaps = np.diff(number[:stop], prepend=0)
        gaps[starts] = 0
        score = times[:stop] * (K1 + 1) / (times[:stop] + K1 * (1 - B + B * length[:stop] / mean))
        cuts = np.append(starts, stop)

        upto = offsets[cuts]
        data = np.frombuffer(places.buffers()[2], np.uint8)[upto[0] : upto[-1]]
        firsts = terms.take(pa.array(starts))
        arrays = [
            t.column("bucket").chunk(0).take(pa.array(starts)), firsts, pa.array(number[starts]), pa.array(number[ends - 1]), pa.array((ends - starts).astype(np.int32)),
            pa.array(np.maximum.reduceat(score, starts)), _cut(gaps, cuts), _cut(times[:stop], cuts), _cut(length[:stop], cuts), _binary(data, upto - upto[0]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names), rest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            upto = np.append(0, np.cumsum(b.column("n").to_numpy()))
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + POSTINGS, "right")) - 1)
                t = _unpacked(b.slice(i, j - i))
                made, rest = packed(t if rest is None or not rest.num_rows else pa.concat_tables([rest, t]), False)
                if made:
                    yield made
                i = j
        if rest is not None and rest.num_rows:
            yield packed(rest, True)[0]

    return postings.mapInArrow(run, schema)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_BYTES for what is computed within, unless the session bounds them already."""
    before = spark.conf.get(BATCH, None)
    if before is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)


def build(units: DataFrame, text: str, path: str) -> Index:
    """Writes the index of units by their text to path, a folder in the shared folder, and opens it. Other columns are kept; null texts have no words."""
    spark = units.sparkSession
    rows = _numbered(units, text)
    rows.drop("words").write.parquet(f"{path}/units")
    stats = rows.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    stats.write.parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").first()["mean"] or 1.0
    dealt = _postings(rows).withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int")).repartition("bucket", F.floor(F.col("first") / PIECE)).sortWithinPartitions("bucket", "term", "first")
    with _small_batches(spark):
        _blocks(dealt, mean).write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{path}/blocks")
    return opened(spark, path)


BLOCKS = "term string, first long, last long, n int, most double, numbers binary, counts binary, lengths binary, places binary, bucket int"


def opened(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/units"), spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), stats["count"], stats["mean"] or 1.0)


def lists(index: Index, terms: list[str]) -> DataFrame:
    """The blocks of terms; buckets of others are not opened."""
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    return index.blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms))))


def decoded(blocks: DataFrame, places: bool = False) -> DataFrame:
    """term, number, times and length of each posting, and with places where in its unit the term is."""
    use = ["term", "first", "n", "numbers", "counts", "lengths", *(["places"] if places else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, AT_ONCE) for x in batches for i in range(0, len(x), AT_ONCE)):
            n, first = b.column(2).to_numpy(), b.column(1).to_numpy()
            gaps, times, length = (unvarints(_bytes(b.column(c))) for c in (3, 4, 5))
            number = _numbers(gaps, first, n)
            arrays = [b.column(0).take(pa.array(np.repeat(np.arange(len(b)), n))), pa.array(number), pa.array(times), pa.array(length)]
            if places:
                steps = unvarints(_bytes(b.column(6)))
                begin = np.cumsum(times) - times
                up = np.cumsum(steps)
                at = up - np.repeat(up[begin] - steps[begin], times)
                arrays.append(pa.ListArray.from_arrays(np.append(begin, len(at)).astype(np.int32), pa.array(at)))
            yield pa.RecordBatch.from_arrays(arrays, ["term", "number", "times", "length", *(["at"] if places else [])])

    return blocks.select(*use).mapInArrow(run, "term string, number long, times long, length long" + (", at array<long>" if places else ""))


def _weights(index: Index, terms: list[str]) -> dict[str, float]:
    """How much each term counts, from the lengths of its blocks; a row a term."""
    found = {r.term: r.df for r in lists(index, terms).groupBy("term").agg(F.sum("n").alias("df")).collect()}
    return {t: float(np.log(1 + (index.count - found.get(t, 0) + 0.5) / (found.get(t, 0) + 0.5))) for t in terms}


def _scored(postings: DataFrame, index: Index, terms: list[str], weights: dict[str, float]) -> DataFrame:
    """number and score of all units in postings."""
    times = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("times"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = postings.groupBy("number").agg(F.max("length").alias("length"), *times)

    def part(i: int) -> Column:
        tf = F.col(f"tf{i}")
        return F.lit(weights[terms[i]]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(index.mean)))

    return rows.select("number", F.round(reduce(lambda a, b: a + b, map(part, range(len(terms)))), 6).alias("score"))


def search(index: Index, terms: list[str]) -> DataFrame:
    """The units that have any of the terms, without number and length, with their BM25 score, as retrieval.bm25 gives them."""
    terms = sorted(set(terms))
    found = _scored(decoded(lists(index, terms)), index, terms, _weights(index, terms))
    return index.units.drop("length").join(found, "number").drop("number")


def _spans(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("span", F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN))))


def promising(index: Index, terms: list[str], k: int) -> tuple[DataFrame, dict[str, float]]:
    """The blocks that a search for the k best has to read, with the spans for which it has to, and the weights of terms.

    A span's units score at most the sum of the highest blocks that reach into it. The k-th best score within the spans of the highest blocks is a bound
    from below, so spans that can't reach it are out. Only the blocks' ends and maxima are read for this, and all of a few spans.
    """
    weights = _weights(index, terms)
    weight = reduce(lambda c, t: c.when(F.col("term") == t, F.lit(weights[t])), terms, F.when(F.lit(False), F.lit(0.0)))
    ends = _spans(lists(index, terms).select("term", "first", "last", "n", (weight * F.col("most")).alias("most")))
    # of a term's block only as many units as a span has can be in it
    spans = stored(ends.groupBy("span", "term").agg(F.max("most").alias("most"), F.sum(F.least("n", F.lit(SPAN))).alias("n")).groupBy("span").agg(F.sum("most").alias("bound"), F.max("n").alias("n")), "spans")
    high = spans.orderBy(F.col("bound").desc(), "span").limit(FIRST * k)
    tops = _scored(_within(index, terms, high), index, terms, weights).orderBy(F.col("score").desc()).limit(k)
    least = tops.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
    return spans.where(F.col("bound") >= (least["s"] - 1e-5 if least["n"] == k else 0.0)), weights


def _within(index: Index, terms: list[str], spans: DataFrame) -> DataFrame:
    """Postings of terms in spans, from the blocks that reach into these."""
    some = spans.select("span")
    reach = _spans(lists(index, terms).select("term", "first", "last", "n", "numbers", "counts", "lengths")).join(some, "span", "left_semi").dropDuplicates(["term", "first"])
    return decoded(reach).withColumn("span", F.floor(F.col("number") / SPAN)).join(some, "span", "left_semi").drop("span")


def best(index: Index, terms: list[str], k: int, *ties: str) -> DataFrame:
    """The k best units by score, then by ties, with rank, from the spans that can hold them."""
    terms = sorted(set(terms))
    spans, weights = promising(index, terms, k)
    found = _scored(_within(index, terms, spans), index, terms, weights)
    # all that ties with the k-th best
    kth = found.orderBy(F.col("score").desc()).limit(k).agg(F.min("score").alias("least"))
    found = found.join(F.broadcast(kth), F.col("score") >= F.col("least")).drop("least")
    return top(index.units.drop("length").join(found, "number").drop("number"), k, *ties)


def phrase(index: Index, words: list[str]) -> DataFrame:
    """The units that have the words one after the other, without number and length, with times, from the places in the words' lists."""
    rows = decoded(lists(index, words), places=True)
    found = None
    for i, w in enumerate(words):
        here = rows.where(F.col("term") == w).select("number", F.transform("at", lambda p: p - i).alias(f"at{i}"))  # noqa: B023
        found = here.withColumnRenamed("at0", "at") if found is None else found.join(here, "number").select("number", F.array_intersect("at", f"at{i}").alias("at")).where(F.size("at") > 0)
    return index.units.drop("length").join(found.select("number", F.size("at").cast("long").alias("times")), "number").drop("number")
