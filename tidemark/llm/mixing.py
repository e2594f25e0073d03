"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a row of it then wants
target / source size copies. The whole part is given; the fractional parts of
a source are rounded by pivotal steps: two rows exchange probability, with their sizes
as exchange rate, until one of them is 0 or 1. A step keeps every row's expectation
and the sum of size times probability, so what a source takes differs from its target
by less than its last undecided row. A pair decides its smaller row, so a large one would be the last: rows that are large beside what follows
them (``LARGE``) and unlike it (``UNLIKE``) are decided first, each paired with all that follow as one, and the others pair by pair.

Rows are dealt to buckets of about ``BUCKET`` rows by a hash of their content, so a large
source is spread over many tasks. Each bucket pairs its rows and leaves one undecided at most; these
are combined in a tree of fan-in ``FAN`` until each source has one left, whatever the size of a source. Random
numbers depend on seed, source, level and bucket only, so reruns agree on any cluster.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import stored, table

BUCKET = 4096
FAN = 64
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: A row is large if it is more than this part of the rows that follow it in its bucket, and so many times their median. Rows of about one size are paired, however few.
LARGE, UNLIKE = 1 / 32, 4.0
#: Probabilities this near to 0 or 1 are taken as that.
EXACT = 1e-12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> and target, for a table with one row per source.

    Sources in order of their code points, null last, weigh weights, repeating. Targets are in proportion
    to them and sum to the sum of the sizes, but none is above cap times its source's size; what is over goes to the others.
    In order of cap * size / weight a source is held at its cap if its share of what the sources before it have left is above it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(order) - 1
    weight = reduce(lambda c, kw: c.when(F.pmod(rank, F.lit(len(weights))) == kw[0], F.lit(float(kw[1]))), enumerate(weights), F.when(F.lit(False), F.lit(0.0)))
    weighted = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    share = (
        weighted.withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("held", F.col("most") * F.col("left_weight") < F.col("weight") * F.col("left_words"))
        .withColumn("free_words", F.sum("source_size").over(every) - F.sum(F.when(F.col("held"), F.col("most")).otherwise(0.0)).over(every))
        .withColumn("free_weight", F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("weight"))).over(every))
    )
    free = F.least(F.col("weight") * F.col("free_words") / F.col("free_weight"), F.col("most"))
    return share.select("source", "source_size", F.when(F.col("held"), F.col("most")).otherwise(free).alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds p in the given order; returns p and the place of the one row that is still fractional, or -1.

    Two fractional rows exchange size times probability until one of them has probability 0 or 1;
    the two directions are drawn in inverse proportion to their lengths, so expectations stay.
    """
    size, p = size.astype(float).tolist(), p.astype(float).tolist()
    at = -1
    for j, u in enumerate(rng.random(len(p)).tolist()):
        if not EXACT < p[j] < 1.0 - EXACT:
            p[j] = float(round(p[j]))
            continue
        if at < 0:
            at = j
            continue
        i = at
        up = min((1.0 - p[i]) * size[i], p[j] * size[j])
        down = min(p[i] * size[i], (1.0 - p[j]) * size[j])
        moved = up if u * (up + down) < down else -down
        p[i], p[j] = p[i] + moved / size[i], p[j] - moved / size[j]
        at = -1
        for k in (i, j):
            if EXACT < p[k] < 1.0 - EXACT:
                at = k
            else:
                p[k] = float(round(p[k]))
    return np.array(p), at


def rounded(size: np.ndarray, p: float, rng: np.random.Generator) -> np.ndarray:
    """Rounds rows, sorted from the largest on, that all have probability p; one at most stays fractional.

    A large row meets all that follow it as one: it becomes 0 or 1 and they share the difference, so they go on with one common probability; where they can't
    take it all, they become 0 or 1 and the row stays fractional. From the first row on that is not large, rows are paired.
    """
    out, i = np.full(len(size), p), 0
    rest = np.concatenate((np.cumsum(size[::-1])[::-1][1:], np.zeros(1)))
    while i < len(size) and EXACT < p < 1.0 - EXACT and 0.0 < LARGE * rest[i] < size[i] and size[i] > UNLIKE * size[(i + 1 + len(size)) // 2]:
        s, r = float(size[i]), float(rest[i])
        up, down = min((1.0 - p) * s, p * r), min(p * s, (1.0 - p) * r)
        moved = up if rng.random() * (up + down) < down else -down
        out[i], p = p + moved / s, p - moved / r
        i += 1
        if EXACT < out[i - 1] < 1.0 - EXACT:
            out[i:] = round(p)
            return out
        out[i - 1] = round(out[i - 1])
    out[i:] = pivotal(size[i:], np.full(len(size) - i, p), rng)[0]
    return out


def _rng(*key: int) -> np.random.Generator:
    return np.random.default_rng([int(x) & 0xFFFFFFFF for x in key])


def _step(seed: int, level: int, last: bool):
    """A node of the tree: rounds what its children left undecided; the last node of a source draws for the one row that remains."""

    def step(t: pa.Table) -> pa.Table:
        t = t.sort_by([("piece_size", "descending"), ("bucket", "ascending")])
        rng = _rng(seed, t["source_key"][0].as_py(), t["source_key"][0].as_py() >> 32, level, t["node"][0].as_py())
        p, at = pivotal(t["piece_size"].to_numpy(), t["part"].to_numpy(), rng)
        if last and at >= 0:
            p[at] = float(rng.random() < p[at])
        return t.set_column(t.schema.get_field_index("part"), "part", pa.array(p))

    return step


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """rows (with columns source, size and mix_key) -> and source_size, target and copies.

    mix_key is a long that any rerun gives the same row; rows that repeat in all columns are
    interchangeable. A null source is a source of its own; rows of size 0 get no copy beyond the whole ones
    and a source of size 0 gets none. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    per = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "sources")
    plan = targets(per.select("source", "source_size"), weights, cap)
    plan = plan.join(per.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = stored(plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    most = per.agg(F.max("n_rows")).first()[0] or 0

    names = [c for c in rows.columns if c != "mix_key"]
    dealt = rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    dealt = (
        dealt.withColumn("source_key", F.coalesce(F.xxhash64("source"), F.lit(0)))
        .withColumn("bucket", F.pmod("mix_key", F.ceil(F.col("n_rows") / BUCKET)))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0))
        .withColumn("piece_size", F.col("size").cast("double"))
        .drop("n_rows", "rate")
    )

    def level0(t: pa.Table) -> pa.Table:
        t = t.take(np.lexsort((t["mix_key"].to_numpy(), -t["piece_size"].to_numpy())))
        rng = _rng(seed, t["source_key"][0].as_py(), t["source_key"][0].as_py() >> 32, 0, t["bucket"][0].as_py())
        size, part = t["piece_size"].to_numpy(), t["part"].to_numpy().copy()
        open_rows = part > 0  # one probability in a source; rows of size 0 are last and have none
        if open_rows.any():
            part[open_rows] = rounded(size[open_rows], float(part[open_rows][0]), rng)
        return t.set_column(t.schema.get_field_index("part"), "part", pa.array(part))

    first = stored(dealt.groupBy("source_key", "bucket").applyInArrow(level0, dealt.schema), "mix-level-0")
    done = first.where("part in (0, 1)")
    left = first.where("part not in (0, 1)")
    levels = max(1, math.ceil(math.log(max(1, math.ceil(most / BUCKET)), FAN)))
    open_rows = left.select("source_key", "bucket", "piece_size", "part", F.col("bucket").alias("node"))
    settled = []
    for level in range(1, levels + 1):
        grouped = open_rows.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("source_key", "node")
        now = stored(grouped.applyInArrow(_step(seed, level, level == levels), open_rows.schema), f"mix-level-{level}")
        settled.append(now.where("part in (0, 1)"))
        open_rows = now.where("part not in (0, 1)")
    decided = reduce(DataFrame.unionByName, settled).select("source_key", "bucket", F.col("part").alias("decided"))
    left = left.join(decided, ["source_key", "bucket"])  # a row a bucket
    done = done.withColumn("decided", F.col("part"))
    both = done.unionByName(left.select(*done.columns))
    return both.select(*names, "source_size", "target", (F.col("whole") + F.col("decided").cast("long")).alias("copies"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """docs in the mix: each row as often as it has copies, so perhaps not at all; all columns stay.

    Sizes are words of text, 0 for null. Names of docs' columns don't clash with those used here: they are set aside meanwhile.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    t, s = f"c{names.index(text)}", f"c{names.index(source)}"
    rows = plain.select("*", F.col(s).cast("string").alias("source"), n_words(F.col(t)).alias("size"), F.xxhash64(*plain.columns).alias("mix_key"))
    out = copies(rows, weights, cap, seed).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that a mix of 5 : 2 : 1 takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = copies(docs.withColumn("mix_key", F.xxhash64("doc_id", "source", "size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
