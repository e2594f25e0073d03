"""Language identification by prediction by partial matching.

Each language has its own context tree over bytes of lower-cased text: for every order up to ``ORDER`` the contexts of that many bytes and the bytes that followed them.
A byte costs -log2 of its probability: c / (n + d) where the context has seen it (n followers, d distinct), else the escape d / (n + d) times what
the shorter context gives it among the bytes that the longer one has not seen; below order 0 all 256 bytes are alike. The statistics are frozen
after fitting. A tree holds only what its language was seen with, sorted: a cost for each byte seen in a context, and one for the escape from each context. So a
tree has at most a byte of each order for every byte of its sample, and any number of languages share nothing that is dense. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .tables import table

ORDER = 3
#: A context and the byte after it are one number.
KEY = np.dtype("<u4" if ORDER < 4 else "<u8")
#: Bytes of labelled text a language that the model is fitted on, about: stretches of STRETCH characters are taken by a hash at the rate that gives so much, one at least.
SAMPLE_BYTES = 1 << 20
#: Bytes of labelled text of all languages together; where there are more languages than it has room for, each has an equal part of it, or a stretch.
TOTAL_BYTES = 8 << 20
STRETCH = 1 << 13
PAD = 32


def _windows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each byte the number that the ORDER bytes before it and it make, itself last; texts are padded with PAD in front."""
    out = data.astype(KEY)
    full = np.diff(bounds) > 0
    starts, ends = bounds[:-1][full], bounds[1:][full]
    for k in range(1, ORDER + 1):
        before = np.full(len(data), PAD, KEY)
        before[k:] = data[: len(data) - k] if len(data) > k else 0
        for j in range(k):
            at = starts + j
            before[at[at < ends]] = PAD
        out |= before << KEY.type(8 * k)
    return out


def _last(window: np.ndarray, order: int) -> np.ndarray:
    """What contexts of that order see of windows."""
    return window & KEY.type((1 << (8 * order + 8)) - 1)


class Order(NamedTuple):
    """One order of a tree: the bits of each byte that was seen in a context, and those of each context's escape. keys and contexts ascend."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def tree(windows: np.ndarray, times: np.ndarray) -> list[Order]:
    """The tree of a language from its windows and how often each was seen."""
    orders: list[Order] = []
    for k in range(ORDER + 1):
        keys, inverse = np.unique(_last(windows, k), return_inverse=True)
        c = np.bincount(inverse, weights=times, minlength=len(keys))
        contexts, heads, d = np.unique(keys >> KEY.type(8), return_index=True, return_counts=True)
        n = np.add.reduceat(c, heads)
        # What was seen in a context was seen in the shorter one too.
        shorter = np.exp2(-orders[-1].bits[np.searchsorted(orders[-1].keys, _last(keys, k - 1))]) if k else np.full(len(keys), 1 / 256)
        rest = np.maximum(1.0 - np.add.reduceat(shorter, heads), 1e-9)
        orders.append(Order(keys, np.repeat(np.log2(n + d), d) - np.log2(c), contexts, np.log2(n + d) - np.log2(d) + np.log2(rest)))
    return orders


def _find(ascending: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of asked is, and whether it is there."""
    at = np.minimum(np.searchsorted(ascending, asked), len(ascending) - 1)
    return at, ascending[at] == asked


def bits_of(orders: list[Order], windows: np.ndarray) -> np.ndarray:
    """What the last byte of each window costs: from the longest context on, escapes until one has seen it."""
    out, left = np.zeros(len(windows)), np.arange(len(windows))
    for k in range(ORDER, -1, -1):
        asked = _last(windows[left], k)
        at, there = _find(orders[k].keys, asked)
        out[left[there]] += orders[k].bits[at[there]]
        left, asked = left[~there], asked[~there]
        at, there = _find(orders[k].contexts, asked >> KEY.type(8))
        out[left[there]] += orders[k].escapes[at[there]]
    out[left] += 8.0
    return out


@dataclass
class Model:
    """The languages, in order, and the tree of each."""

    languages: list[str]
    trees: list[list[Order]]

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits that each text takes in each language. Each distinct window is looked up once in each tree."""
        full = np.diff(bounds) > 0
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        if full.any():
            window = _windows(data, bounds)
            distinct = np.unique(window)
            at = np.searchsorted(distinct, window)
            for k, orders in enumerate(self.trees):
                out[full, k] = np.add.reduceat(bits_of(orders, distinct)[at], bounds[:-1][full])
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Model:
    """Fits on a sample of about sample_bytes a language and total_bytes in all; rows without text or language are left out. Without any the model knows no language.

    Texts of any length are cut into stretches. Which are in the sample depends on the rows' keys and texts only; the stretch of a language that is drawn first is always in it, so
    every language is learned. A tree is made in a task from the counts of its language's sample. What reaches the driver are a row a language and the trees: ORDER + 1 entries for each
    byte of the sample at most, and a small part of that for words.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / STRETCH).cast("int"))
    draw = lambda at: F.pmod(F.xxhash64(F.col("own"), at), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("own", F.xxhash64("key", "text"))
    totals = rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n"), F.min(F.array_min(F.transform(places, draw))).alias("first")).collect()
    if not totals:
        return Model([], [])
    sample_bytes = min(sample_bytes, total_bytes // len(totals))
    rate = spark.createDataFrame([(r["lang"], max(r["first"], min(1.0, sample_bytes / r["n"]))) for r in totals], "lang string, rate double")
    taken = F.filter(places, lambda at: draw(at) <= F.col("rate"))
    sample = rows.join(F.broadcast(rate), "lang").select("lang", "text", F.explode(taken).alias("at"))  # a row per language is sent
    sample = sample.select("lang", F.substring("text", F.col("at") * STRETCH + 1, F.lit(STRETCH)).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for g in words.byte_groups(pc.utf8_lower(b.column(1))):
                window = _windows(g.data, g.bounds)
                mine = np.repeat(langs[g.first : g.first + g.n_docs], np.diff(g.bounds))
                for x in sorted(set(mine)):
                    seen, times = np.unique(window[mine == x], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(times, pa.int64())], ["lang", "window", "times"])

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        orders = tree(t["window"].to_numpy().astype(KEY), t["times"].to_numpy())
        columns = {name: pa.array([getattr(o, name).tobytes() for o in orders], pa.binary()) for name in Order._fields}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(orders), pa.string()), "place": pa.array(range(len(orders)), pa.int32()), **columns})

    counts = sample.mapInArrow(count, "lang string, window long, times long").groupBy("lang", "window").agg(F.sum("times").alias("times"))
    grown = counts.groupBy("lang").applyInArrow(grow, "lang string, place int, keys binary, bits binary, contexts binary, escapes binary").collect()
    trees: dict[str, list[Order]] = {}
    for r in sorted(grown, key=lambda r: (r["lang"], r["place"])):
        trees.setdefault(r["lang"], []).append(Order(*(np.frombuffer(r[name], t) for name, t in zip(Order._fields, (KEY, "<f8", KEY, "<f8")))))
    return Model(list(trees), list(trees.values()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred, score (posterior probability under equal priors) and n_bits (code length in that language).

    lang_pred is und, with score 0, where the text is null, has no letter, or the model knows no language. Texts are
    read whole. Columns that bear a new name are replaced; rows that repeat stay.
    """
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score", "n_bits")]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("text_to_score"))
    schema = source.drop("text_to_score").schema.add("lang_pred", "string").add("score", "double").add("n_bits", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # entries by TOTAL_BYTES, or a stretch for each language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for b in batches:
            best, score, bits = [], [], []
            for g in words.byte_groups(pc.utf8_lower(b.column(len(keep)))):
                full = np.diff(g.bounds) > 0
                letter = np.zeros(g.n_docs, bool)
                ascii_sum = np.concatenate((np.zeros(1, np.int64), np.cumsum((g.data >= 97) & (g.data <= 122))))
                letter[:] = ascii_sum[g.bounds[1:]] > ascii_sum[g.bounds[:-1]]
                for i in np.flatnonzero(full & ~letter).tolist():
                    letter[i] = any(map(str.isalpha, g.data[g.bounds[i] : g.bounds[i + 1]].tobytes().decode()))
                if not model.languages:
                    letter[:] = False
                n = model.lengths(g.data, g.bounds) if model.languages else np.zeros((g.n_docs, 1))
                k = n.argmin(1)
                least = n[np.arange(len(n)), k]
                p = 1.0 / np.exp2(np.maximum(least[:, None] - n, -1000.0)).sum(1)
                best.append(np.where(letter, k, len(names) - 1))
                score.append(np.where(letter, p, 0.0))
                bits.append(np.where(letter, least, 0.0))
            join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names[join(best, int)], pa.string()), pa.array(join(score, float)), pa.array(join(bits, float))], [*keep, "lang_pred", "score", "n_bits"])

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)) == part


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~out).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_bits")
