"""Proofs that a write is in a log, and that a log has only grown: a Merkle tree a batch, a tree over the batches' roots.

The tree is that of RFC 6962: leaves are digests of 0 and the row's receipt, nodes of 1 and both parts, and of n leaves the greatest power of two below n are on the left. Levels
are made one by one: the nodes of a level join by half their place, so a batch of any size is spread over tasks and takes as many rounds as it has levels. Who keeps the
root, 32 bytes, can check a write with as many digests as the tree has levels, without the log.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stored


def _leaf(receipt: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(receipt, "UTF-8")), 256)


def _node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def tree(receipts: DataFrame, batch: str, order: list[str], receipt: str = "receipt") -> DataFrame:
    """All nodes of the trees of batches: batch, level (leaves 0), place and digest; a node that has no other beside it goes up as it is.

    Places follow order, which is to be unlike for all rows of a batch. They are counted by ranges, so a batch may be in many tasks.
    """
    by = [batch, *order]
    rows = receipts.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(batch).alias("batch"), _leaf(F.col(receipt)).alias("digest"), F.monotonically_increasing_id().alias("at"))
    rows = stored(rows.withColumn("task", F.shiftright("at", 33)), "leaves")
    # what a task has of a batch before it is a row a task and batch
    parts = rows.groupBy("batch", "task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("batch").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(parts.select("batch", "task", "first", before.alias("before")), ["batch", "task"])
    now = stored(placed.select("batch", F.lit(0).alias("level"), (F.col("before") + F.col("at") - F.col("first")).alias("place"), "digest"), "level")
    levels, most = [now], now.agg(F.max("place")).first()[0] or 0
    for level in range(1, most.bit_length() + 1):
        up = now.groupBy("batch", F.shiftright("place", 1).alias("place")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("digest"))).alias("left"), F.max(F.when(F.col("place") % 2 == 1, F.col("digest"))).alias("right"))
        digest = F.when(F.col("right").isNull(), F.col("left")).otherwise(_node(F.col("left"), F.col("right")))
        now = stored(up.select("batch", F.lit(level).alias("level"), "place", digest.alias("digest")), "level")
        levels.append(now)
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out


def roots(nodes: DataFrame) -> DataFrame:
    """batch, root and size (leaves) of each tree."""
    sizes = nodes.where("level = 0").groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    tops = nodes.where("place = 0").groupBy("batch").agg(F.max_by("digest", "level").alias("root"))
    return tops.join(sizes, "batch")


def proofs(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """For leaves (batch, place): batch, place, digest and path: from below, the digests beside it, each with whether it is to the left.

    A leaf meets one node a level, by its own place there, so a proof is a join, whatever the size of a batch.
    """
    levels = nodes.agg(F.max("level")).first()[0] or 0
    steps = asked.select("batch", "place").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    above = F.expr("shiftright(place, level)")
    beside = steps.select("batch", F.col("place").alias("leaf"), "level", F.when(above % 2 == 0, above + 1).otherwise(above - 1).alias("place"), (above % 2 == 1).alias("left"))
    met = beside.join(nodes, ["batch", "level", "place"]).groupBy("batch", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "left", "digest"))).alias("path"))
    own = asked.select("batch", "place").distinct().join(nodes.where("level = 0").drop("level"), ["batch", "place"])
    path = F.transform(F.coalesce("path", F.array().cast("array<struct<level:int,left:boolean,digest:string>>")), lambda s: F.struct(s["left"].alias("left"), s["digest"].alias("digest")))
    return own.join(met.withColumnRenamed("leaf", "place"), ["batch", "place"], "left").select("batch", "place", "digest", path.alias("path"))


def proven(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda d, s: F.when(s["left"], _node(s["digest"], d)).otherwise(_node(d, s["digest"])))


def leaf_of(receipt: Column) -> Column:
    return _leaf(receipt)


def _hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\1" + left + right).digest()


def _root(digests: list[bytes]) -> bytes:
    if not digests:
        return hashlib.sha256(b"").digest()
    if len(digests) == 1:
        return digests[0]
    k = 1 << (len(digests) - 1).bit_length() - 1
    return _hash(_root(digests[:k]), _root(digests[k:]))


def log_root(batch_roots: list[str]) -> str:
    """The root over the roots of batches, in their order; a log has few batches, and compaction makes them fewer."""
    return _root([hashlib.sha256(b"\0" + bytes.fromhex(r)).digest() for r in batch_roots]).hex()


def consistency(batch_roots: list[str], size: int) -> list[str]:
    """Digests that show that the log of the first size batches is the beginning of this one."""

    def sub(d: list[bytes], m: int, whole: bool) -> list[bytes]:
        if m == len(d):
            return [] if whole else [_root(d)]
        k = 1 << (len(d) - 1).bit_length() - 1
        return [*sub(d[:k], m, whole), _root(d[k:])] if m <= k else [*sub(d[k:], m - k, False), _root(d[:k])]

    leaves = [hashlib.sha256(b"\0" + bytes.fromhex(r)).digest() for r in batch_roots]
    return [x.hex() for x in sub(leaves, size, True)] if 0 < size <= len(leaves) else []


def consistent(old: str, old_size: int, new: str, new_size: int, proof: list[str]) -> bool:
    """Whether proof shows that a log of new_size batches and root new begins with that of old_size batches and root old."""
    if old_size == new_size:
        return old == new and not proof
    if not 0 < old_size < new_size:
        return old_size == 0
    path = [bytes.fromhex(x) for x in proof]
    if old_size & (old_size - 1) == 0:
        path.insert(0, bytes.fromhex(old))
    if not path:
        return False
    a, b = old_size - 1, new_size - 1
    while a & 1:
        a, b = a >> 1, b >> 1
    first = second = path[0]
    for step in path[1:]:
        if b == 0:
            return False
        if a & 1 or a == b:
            first, second = _hash(step, first), _hash(step, second)
            while not a & 1 and a:
                a, b = a >> 1, b >> 1
        else:
            second = _hash(second, step)
        a, b = a >> 1, b >> 1
    return b == 0 and first.hex() == old and second.hex() == new
