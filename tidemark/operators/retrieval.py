"""Search over documents: passages, BM25, fusion of ranked lists, merging of equal results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BREAKS, times_of, tokens
from ..plans.lineage import stored

K1, B = 1.2, 0.75
#: Longs of the parities by which pairs of sets are ruled out.
PARITIES = 8


def passages(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, pos and passage: the lines of each text that are not empty, numbered from 0 with empty ones counted."""
    return docs.select(doc_id, source, F.posexplode(F.split(text, "\n")).alias("pos", "passage")).where("passage <> ''").withColumn("pos", F.col("pos").cast("long"))


def scores(units: DataFrame, text: str, searches: dict[str, list[str]]) -> DataFrame:
    """units without their text, and for each search a score by its terms (Robertson and Zaragoza, 2009), null where it has none of them.

    Texts are read once: their counts of the terms are written to the shared folder, and statistics and scores come from there. A single row of
    statistics is all that is broadcast.
    """
    terms = sorted({t for found in searches.values() for t in found})
    keep = [c for c in units.columns if c != text]
    words = units.withColumn("words", tokens(F.col(text)))
    counted = stored(words.select(*keep, F.size("words").cast("long").alias("length"), *(times_of(F.col("words"), t).alias(f"tf{i}") for i, t in enumerate(terms))), "counts")
    seen = (F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))
    totals = counted.agg(F.count(F.lit(1)).alias("units"), F.nullif(F.avg("length"), F.lit(0.0)).alias("mean"), *seen).withColumn("one", F.lit(1))
    both = counted.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")

    def part(i: int) -> Column:
        idf, tf = F.log(1 + (F.col("units") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.col(f"tf{i}")
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    def score(found: list[str]) -> Column:
        at = [terms.index(t) for t in found]
        hit = reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in at))
        return F.when(hit, F.round(reduce(lambda a, b: a + b, map(part, at)), 6))

    return both.select(*keep, *(score(found).alias(name) for name, found in searches.items()))


def bm25(units: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """units without their text, with score, those that have any of the terms."""
    return scores(units, text, {"score": terms}).where("score is not null")


def ranked(scored: DataFrame, *ties: str) -> DataFrame:
    """All rows by score, then by ties, with rank from 1.

    Rows are dealt by ranges and numbered within each; the numbers of rows in the ranges before come from a row a range.
    """
    order = [F.col("score").desc(), *ties]
    number = F.monotonically_increasing_id()
    rows = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", number)
    rows = stored(rows.withColumn("part", F.shiftright("number", 33)).withColumn("number", F.col("number").bitwiseAND(F.lit((1 << 33) - 1))), "ranks")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    return rows.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("number") + 1).drop("part", "number", "before")


def top(ranked: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best by score, then by ties, with rank."""
    best = ranked.orderBy(F.col("score").desc(), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), *ties)).cast("long"))


def fused(lists: dict[str, DataFrame], key: str, constant: int = 60) -> DataFrame:
    """key, engines and score of the union of ranked lists (key, rank), by reciprocal ranks (Cormack et al., 2009)."""
    union = reduce(DataFrame.unionByName, (df.select(key, "rank", F.lit(name).alias("engine")) for name, df in lists.items()))
    return union.groupBy(key).agg(F.count_distinct("engine").alias("engines"), F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"))


def equal_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """first_id and copies of each distinct text."""
    return docs.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(doc_id).alias("first_id"), F.count(F.lit(1)).alias("copies")).select("first_id", "copies")


def parities(words: Column) -> list[Column]:
    """Of a set of words, how many have each of 64 * PARITIES values of a hash, modulo 2: bits in PARITIES longs. Two sets differ in as many words as their bits differ, at least."""
    values = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * PARITIES)).cast("int"))
    bit = lambda k: lambda bits, v: F.when(F.shiftright(v, 6) == k, bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63))))).otherwise(bits)
    return [F.aggregate(values, F.lit(0).cast("long"), bit(k)).alias(f"p{k}") for k in range(PARITIES)]


def having(units: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """The rows that bm25 gives a score, with their text: those that have any of the terms (lower-case words)."""
    inner = BREAKS.removesuffix("+")
    return units.where(F.lower(F.col(text)).rlike(f"(?:^|{inner})(?:{'|'.join(map(re.escape, terms))})(?:{inner}|\\z)"))


def merged(results: DataFrame, key: str, text: str, percent: int = 75, texts: DataFrame | None = None) -> DataFrame:
    """Ranked results (key, rank, text; ranks differ) without those that have a better ranked one of nearly the same words, at any distance in rank.

    texts: where the texts are if results don't have them, rows of key and text, so that texts needn't be shuffled to their ranks.
    """
    from .alike import unlike  # imports index, which imports this

    if texts is not None:
        return unlike(results, texts, key, text, percent)
    return unlike(results, results.select("rank", text), "rank", text, percent)
