"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows are classes of documents with equal sets of n-grams, columns are n-grams. No pair of a large group is ever a row of a table:

1. Columns are dealt to blocks by their hash. A block counts the classes of each column; a column with one class adds to no product and is dropped.
2. Sizes fall into bands, so that rows link within a band or with the next one only. Of two sizes a, b a link needs an overlap of t / (1 + t) * (a + b), so with m columns
   left a row shares one of its m - overlap + 1 rarest with any row of a band that it links with: its prefix for that band, columns in order of their rarity.
3. Tiles: the product is made for a block of left rows and a block of right rows at a time. A tile adds up overlaps of all its pairs,
   discards those below the bound that follows from both sizes, and reports a spanning forest of the links, so no more rows than it has read.
4. First each row meets the hub of a prefix column (its smallest row), so large groups become components by links in proportion to their rows.
5. Then, for columns whose rows are not yet in one component, tasks compare (first for one near row each, then for all) the rows outside the column's largest component with all its rows. Long columns are cut
   into pieces. A pair of two components goes to a tile if the parities of its columns, folded to some bits, differ in no more bits than its bound lets the sets differ:
   sets never differ in less columns than bits, so that loses no link. The components are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .graph import components
from .tables import shuffles, stored, table

N = 5
PERCENT = 75
#: What a text with a word has a match of; the bytes of words.SPACE are no words.
WORD = r"[^\x20\x09-\x0D]"
#: Bytes of text whose n-grams go to a block together.
MESSAGE_BYTES = 2 << 20
#: Bytes of n-grams in a block of columns, left rows of a tile, and entries of its right rows.
BLOCK_BYTES = 32 << 20
LEFT_ROWS = 128
TILE_ENTRIES = 1 << 21
#: Ranges of a block's columns that are sorted one after the other, and products of a tile that are added up at a time.
SLICES = 8
PRODUCTS = 1 << 20
#: Right rows of a tile; rows of a column that a task compares at a time, pairs and bytes that it holds meanwhile.
TILE_ROWS = 1 << 13
PIECE_ROWS = 1024
PAIRS = 1 << 18
HELD = 4 << 20


def _sets(g: words.Group, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, sorted by text and hash: hashes and texts; and the first word of each (any, where it repeats)."""
    h = g.hashes()
    at = words.runs(g.doc, n)
    grams = words.chain(*(h[at + k] for k in range(n))) if len(at) else h[:0]
    doc = g.doc[at]
    counts = np.bincount(g.doc, minlength=g.n_docs)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(g.doc, short)
        whole = np.concatenate([words.chain(*(h[a + k : a + k + 1] for k in range(c)), np.array([c], np.uint64)) for a, c in zip(first, counts[short])])
        grams, doc = np.concatenate((grams, whole)), np.concatenate((doc, short))
    order = np.argsort(grams)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], doc[new], counts


def _classes(grams: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit class and the size of each text's set; texts without a word have size 0."""
    size = np.bincount(doc, minlength=n_docs)
    starts = np.cumsum(size) - size
    full = size > 0
    out = np.zeros(n_docs, np.uint64)
    if full.any():
        sums = [np.add.reduceat(words.mix(grams + np.uint64(salt)), starts[full]) for salt in (1, 2)]
        out[full] = words.chain(*sums, size[full].astype(np.uint64))
    return out, size


def members(docs: DataFrame, doc_id: str, text: str, n: int = N) -> DataFrame:
    """doc_id, class and size (number of distinct n-grams) of each row. doc_id may be a struct."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for g in words.groups(b.column(1)):
                c, s = _classes(*_sets(g, n)[:2], g.n_docs)
                cls.append(c)
                size.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(cls).view(np.int64)), pa.array(np.concatenate(size).astype(np.int64))], ["doc_id", "class", "size"])
        words.release()

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, source.drop("text").schema.add("class", "long").add("size", "long"))


def column_blocks(docs: DataFrame, text: str, blocks: int, n: int = N) -> DataFrame:
    """block and, packed: the classes and sizes of some rows and how many columns of the block each has; the columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in words.groups(b.column(0), MESSAGE_BYTES):
                grams, doc, _ = _sets(g, n)
                cls, size = _classes(grams, doc, g.n_docs)
                once = np.zeros(g.n_docs, bool)
                once[np.unique(cls, return_index=True)[1]] = True  # equal sets are one row
                keep = once[doc]
                grams, doc = grams[keep], doc[keep]
                block = ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
                order = np.argsort(block.astype(np.int32), kind="stable")
                grams, doc, block = grams[order], doc[order], block[order]
                cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else np.zeros(1, int)
                out = []
                for x, y in zip(cut[:-1], cut[1:]):
                    new = np.flatnonzero(np.concatenate(([True], doc[x + 1 : y] != doc[x : y - 1])))
                    rows = doc[x:y][new]
                    counts = np.diff(np.concatenate((new, [y - x])))
                    out.append((int(block[x]), cls[rows].tobytes(), size[rows].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), grams[x:y].tobytes()))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4))], ["block", "classes", "sizes", "counts", "grams"])
        words.release()

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "block int, classes binary, sizes binary, counts binary, grams binary")


def _packed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for chunk in column.chunks for x in chunk]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _several(parts: list[np.ndarray], own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, rows and rarities of the entries in parts whose column has several rows, sorted by column and row. Of SLICES ranges of columns one at a time is copied and sorted."""
    least, most = (int(f(f(x) for x in parts if len(x))) if any(map(len, parts)) else 0 for f in (min, max))
    step = (most - least) // SLICES + 1
    begins, upto = np.cumsum([0, *map(len, parts)]), np.cumsum(counts, dtype=np.int64)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int8))]
    for k in range(SLICES):
        low, high = np.uint64(least + k * step), np.uint64(min(least + (k + 1) * step - 1, (1 << 64) - 1))
        at = [np.flatnonzero((x >= low) & (x <= high)) for x in parts] if least + k * step <= most else []
        if not any(map(len, at)):
            continue
        grams = np.concatenate([x[i] for x, i in zip(parts, at)])
        row = own[np.searchsorted(upto, np.concatenate([i + b for i, b in zip(at, begins)]), "right")]
        order = np.argsort(grams, kind="stable")
        grams, row = grams[order], row[order]
        head = np.concatenate(([True], grams[1:] != grams[:-1]))
        several = ~(head & np.concatenate((head[1:], [True])))
        grams, row = grams[several], row[several]  # columns that came more than once, perhaps from copies in other batches
        order = np.lexsort((row, grams))
        grams, row = grams[order], row[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[new], row[new]
        head = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, int)
        df = np.diff(np.concatenate((head, [len(grams)])))
        keep = np.repeat(df > 1, df)
        found.append((grams[keep], row[keep], np.repeat(np.minimum(8 * np.log2(np.maximum(df, 1)), 127).astype(np.int8), df)[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _shared(t: pa.Table, buckets: int) -> pa.Table:
    """Of one block of columns: for each row its columns that another row has too, and the rarity of each (log2 of its rows); packed by buckets of rows."""
    cls, size, counts = _packed(t["classes"], np.uint64), _packed(t["sizes"], np.uint32), _packed(t["counts"], np.uint32)
    names, first, own = np.unique(cls, return_index=True, return_inverse=True)
    size, own = size[first], own.astype(np.int32)
    grams, row, rarity = _several([np.frombuffer(x.as_buffer(), np.uint64) for chunk in t["grams"].chunks for x in chunk], own, counts)
    bucket = _bucket(names, buckets)
    dealt = np.argsort(bucket, kind="stable")  # rows by bucket
    key = np.zeros(len(names), np.int32)
    key[dealt] = np.arange(len(names))
    order = np.argsort(key[row], kind="stable")
    upto = np.cumsum(np.bincount(bucket[row], minlength=buckets)) if len(row) else np.zeros(buckets, int)
    out = []
    for k in np.flatnonzero(np.diff(upto, prepend=0)).tolist():
        here = order[upto[k - 1] if k else 0 : upto[k]]
        at = row[here]
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        at, n = at[new], np.diff(np.concatenate((new, [len(here)])))
        out.append((k, names[at].tobytes(), size[at].astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), grams[here].tobytes(), rarity[here].tobytes()))
    columns = list(zip(*out)) or [()] * 6
    return pa.table({k: pa.array(c, pa.int32() if k == "bucket" else pa.binary()) for k, c in zip(("bucket", "classes", "sizes", "counts", "grams", "rarities"), columns)})


def _bucket(classes: np.ndarray, buckets: int) -> np.ndarray:
    return ((words.mix(classes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def bands(largest: int, percent: int) -> np.ndarray:
    """The least sizes of bands 0, 1, ...: a size links with those of its own band and of those beside it only."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def parities(grams: np.ndarray, row: np.ndarray, have: np.ndarray) -> list[bytes]:
    """Of each row (entries sorted by row) the parity of its columns at each of 64 to 8192 bits, at least as many as columns up to there."""
    bits = np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(have, 1))), 6, 13).astype(np.int64))
    at = np.cumsum(bits) - bits
    flags = np.bincount(at[row] + (words.mix(grams).astype(np.int64) & (bits[row] - 1)), minlength=int(bits.sum())).astype(np.uint8) & 1
    packed = np.packbits(flags, bitorder="little").tobytes()
    return [packed[x : x + n] for x, n in zip((at // 8).tolist(), (bits // 8).tolist())]


def _rows(t: pa.Table, percent: int) -> pa.Table:
    """The rows of a bucket, put together from their parts in all blocks of columns: those whose columns suffice for a link, rarest columns first."""
    cls, size, counts, grams, rarity = (_packed(t[c], k) for c, k in (("classes", np.uint64), ("sizes", np.uint32), ("counts", np.uint32), ("grams", np.uint64), ("rarities", np.int8)))
    names, first, row = np.unique(cls, return_index=True, return_inverse=True)
    size = size[first].astype(np.int64)
    row = np.repeat(row, counts)
    have = np.bincount(row, minlength=len(names))
    keep = 100 * have >= percent * size
    inside = keep[row]
    grams, rarity, row = grams[inside], rarity[inside], (np.cumsum(keep) - 1)[row[inside]]
    order = np.lexsort((grams, rarity, row))
    grams, row, size, have = grams[order], row[order], size[keep], have[keep]
    offsets = pa.array(np.concatenate(([0], np.cumsum(have))), pa.int32())
    least = bands(int(size.max(initial=1)), percent)
    band = np.searchsorted(least, size, "right") - 1
    # the least overlap with a row of the own band or above, and with one of the band below
    own = -(-percent * (size + least[band]) // (100 + percent))
    below = np.maximum(-(-percent * size // 100), -(-percent * (size + least[np.maximum(band - 1, 0)]) // (100 + percent)))
    prefix = lambda need: pa.array(np.maximum(have - need + 1, 0).astype(np.int32))
    return pa.table({
        "class": pa.array(names[keep].view(np.int64)), "size": pa.array(size), "grams": pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64))), "have": pa.array(have.astype(np.int32)),
        "band": pa.array(band.astype(np.int32)), "n_own": prefix(own), "n_below": prefix(below), "parity": pa.array(parities(grams, row, have), pa.binary()),
    })


ROWS = "class long, size long, grams array<long>, have int, band int, n_own int, n_below int, parity binary"


def incidence(docs: DataFrame, text: str, blocks: int, n: int = N, percent: int = PERCENT) -> DataFrame:
    """ROWS of the rows that could link with another: size, columns that other rows have too (have of them), the rarest first; the first n_own are the prefix for the own band and
    the one above, the first n_below for the one below; parity folds the columns."""

    def shared(t: pa.Table) -> pa.Table:
        words.release()
        return _shared(t, blocks)

    def rows(t: pa.Table) -> pa.Table:
        words.release()
        return _rows(t, percent)

    found = column_blocks(docs, text, blocks, n).groupBy("block").applyInArrow(shared, "bucket int, classes binary, sizes binary, counts binary, grams binary, rarities binary")
    return found.groupBy("bucket").applyInArrow(rows, ROWS)


def _tile(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """The product of two blocks of rows: overlaps of all pairs; the links, as a spanning forest."""

    def parts(t: pa.Table):
        t = t.combine_chunks()
        lists = t["grams"].chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64()))
        return t["class"].to_numpy(), t["size"].to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()

    (lc, ls, ln, lg), (rc, rs, rn, rg) = parts(left), parts(right)
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(lc) or not len(rc):
        return empty
    row = np.repeat(np.arange(len(lc)), ln)
    order = np.argsort(lg, kind="stable")
    lg, row = lg[order], row[order]
    low, high = np.searchsorted(lg, rg, "left"), np.searchsorted(lg, rg, "right")
    overlap = np.zeros(len(rc) * len(lc), np.int32)
    right_row, times = np.repeat(np.arange(len(rc)), rn), high - low
    ends = np.cumsum(times)
    a = 0
    while a < len(times):  # as many entries of the right block as give about PRODUCTS products
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PRODUCTS, "right")))
        t = times[a:b]
        at = np.repeat(low[a:b] - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
        overlap += np.bincount(np.repeat(right_row[a:b], t) * len(lc) + row[at], minlength=len(overlap)).astype(np.int32)
        a = b
    i, j = np.divmod(np.flatnonzero(overlap), len(lc))
    o = overlap[i * len(lc) + j].astype(np.int64)
    link = (100 * o >= percent * (rs[i] + ls[j] - o)) & (rc[i] != lc[j])
    i, j = i[link], j[link]
    # spanning forest: left rows that share a right row are joined by way of it, so each right row is linked with its first left row of each group only
    root = list(range(len(lc)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out, b_out, last, reached = [], [], -1, set()
    for x, y in zip(i.tolist(), j.tolist()):
        if x != last:
            last, reached = x, set()
        r = find(y)
        if r in reached:
            continue
        if reached:  # this right row joins two groups of left rows
            other = next(iter(reached))
            root[r] = find(other)
        reached.add(find(y))
        a_out.append(int(rc[x]))
        b_out.append(int(lc[y]))
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def tile_links(rows: DataFrame, wanted: DataFrame, lefts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a and b of links between left rows (left_block, class) and the right rows wanted with their block (left_block, class)."""
    cells = wanted.join(rows.select("class", "size", "grams"), "class")
    cells = stored(cells, "cells")
    tiles = cells.groupBy("left_block").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("grams")) / TILE_ENTRIES), F.ceil(F.count(F.lit(1)) / TILE_ROWS)).cast("int").alias("tiles"))
    tiles = stored(tiles, "tiles")
    right = cells.join(tiles, "left_block").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")).drop("tiles")
    left = lefts.join(rows.select("class", "size", "grams"), "class").join(tiles, "left_block")
    left = left.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        return _tile(a, b, percent)

    pair = left.groupBy("left_block", "tile").cogroup(right.groupBy("left_block", "tile"))
    return pair.applyInArrow(product, "a long, b long")


def _numbered(lefts: DataFrame) -> DataFrame:
    """Left rows and their blocks: by hash, about LEFT_ROWS in each."""
    lefts = stored(lefts, "lefts")
    n = max(1, -(-lefts.count() // LEFT_ROWS))
    return lefts.withColumn("left_block", F.pmod(F.xxhash64("class"), F.lit(n)))


def _folded(parity: list[bytes], width: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of 64-bit words: where each entry is among those of at least as many, and their parities folded to it."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    w = int(width.max(initial=1))
    at, folded = np.zeros(len(width), np.int64), np.zeros((0, w), np.uint64)
    while w >= 1:
        own = np.flatnonzero(width == w)
        at[own] = len(folded) + np.arange(len(own))
        new = np.frombuffer(b"".join(parity[i] for i in own.tolist()), np.uint64).reshape(-1, w)
        folded = np.concatenate((folded, new))
        out[w] = at.copy(), folded
        if w > 1:
            folded = folded[:, : w // 2] ^ folded[:, w // 2 :]
        w //= 2
    return out


def _near(columns: dict[str, np.ndarray], parity: list[bytes], percent: int, one: bool) -> np.ndarray:
    """Of entries sorted by tile and side (left ones first): the pairs of a left and a right entry of a tile that may link, each once; with one, only that with the
    smallest right class for each left entry."""
    tile, right = columns["tile"], columns["right"]
    ends = np.flatnonzero(np.concatenate((tile[1:] != tile[:-1], [True]))) + 1
    begins = np.concatenate(([0], ends[:-1]))
    lefts = np.add.reduceat((~right).astype(np.int64), begins)
    left = np.flatnonzero(~right)
    group = np.repeat(np.arange(len(begins)), lefts)
    low, times = (begins + lefts)[group], (ends - begins - lefts)[group]
    width = np.array([len(x) // 8 for x in parity], np.int64)
    folded = _folded(parity, width)
    cls, size, have, root, outer, own = (columns[c] for c in ("class", "size", "have", "root", "outer", "own"))
    done, found, a = np.cumsum(times), [np.zeros((0, 2), np.int64)], 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
        t = times[a:b]
        x = np.repeat(left[a:b], t)
        y = np.repeat(low[a:b] - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
        ok = (root[x] != root[y]) & (own[x] | own[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])) & (one | ~outer[y] | (cls[x] < cls[y]))
        x, y = x[ok], y[ok]
        differ = have[x] + have[y] - 2 * -(-percent * (size[x] + size[y]) // (100 + percent))
        common = np.minimum(width[x], width[y])
        for w in np.unique(common).tolist():
            here = np.flatnonzero(common == w)
            at, bits = folded[w]
            near = np.bitwise_count(bits[at[x[here]]] ^ bits[at[y[here]]]).sum(1, dtype=np.int64) <= differ[here]
            i, j = x[here[near]], y[here[near]]
            if one:
                order = np.lexsort((cls[j], i))
                order = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))] if len(order) else order
                i, j = i[order], j[order]
            found.append(np.stack((cls[i], cls[j]), 1))
        a = b
    return np.unique(np.concatenate(found), axis=0)


def near_pairs(entries: DataFrame, percent: int, one: bool) -> DataFrame:
    """a and b of the pairs in a tile that may link, with one at most one for each left entry; entries have gram, band, i, j (the tile), right and what _near needs."""
    entries = entries.repartition("gram", "band", "i", "j").sortWithinPartitions("gram", "band", "i", "j", "right")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: bool) -> pa.RecordBatch:
            """Compares the tiles that are complete; the last one may go on in the next batch."""
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t[c].to_numpy() for c in ("gram", "band", "i", "j")])
            new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))
            cut = t.num_rows if whole else int(np.flatnonzero(new)[-1])
            held = t.slice(cut).to_batches()
            if not cut:
                return pa.RecordBatch.from_pylist([], schema)
            t = t.slice(0, cut)
            columns = {c: t[c].to_numpy(zero_copy_only=False) for c in ("class", "size", "root", "outer", "own", "right")}
            columns |= {"tile": np.cumsum(new)[:cut], "have": t["have"].to_numpy().astype(np.int64)}
            found = _near(columns, t["parity"].to_pylist(), percent, one)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
                if size > HELD:
                    yield flush(False)
                    size = 0
        if held:
            yield flush(True)

    return entries.mapInArrow(run, "a long, b long").distinct()


def class_components(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node (a class) and root of all classes that link with another."""
    rows = stored(rows, "incidence")
    prefix = lambda band, n, own: rows.select("class", band.alias("band"), F.lit(own).alias("own"), F.explode(F.slice("grams", F.lit(1), F.col(n))).alias("gram"))
    entries = stored(prefix(F.col("band"), "n_own", True).unionByName(prefix(F.col("band") - 1, "n_below", False)), "prefixes")

    hubs = stored(entries.groupBy("gram", "band").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    star = entries.join(hubs, ["gram", "band"]).where("class <> hub").groupBy("class", "hub").agg(F.count(F.lit(1)).alias("votes"))
    star = stored(star.groupBy("class").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub")), "stars")
    lefts = _numbered(star.select(F.col("hub").alias("class")).distinct())
    wanted = star.join(lefts.withColumnRenamed("class", "hub"), "hub").select("left_block", "class").distinct()
    links = stored(tile_links(rows, wanted, lefts, percent), "links")
    known = stored(components(links), "components")

    # columns with one row are of no use here, so they go before anything is joined
    shared = stored(entries.join(hubs.select("gram", "band"), ["gram", "band"], "left_semi"), "shared")
    # one near row for each first, which makes components of groups that have no hub in common; then all pairs of what is still apart
    for one in (True, False):
        pairs = stored(near_pairs(_open_tiles(rows, shared, known), percent, one), "pairs")
        lefts = _numbered(pairs.select(F.col("a").alias("class")).distinct())
        wanted = pairs.join(lefts.withColumnRenamed("class", "a"), "a").select("left_block", F.col("b").alias("class")).distinct()
        links = links.unionByName(stored(tile_links(rows, wanted, lefts, percent), "links"))
        known = components(links)
        if one:
            known = stored(known, "components")
    return known


def _open_tiles(rows: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """What near_pairs compares: for prefix columns with rows of several components, those outside of its largest one (left) and all (right), in pieces."""
    facts = rows.select("class", "size", "have", "parity").join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    facts = stored(facts, "facts")
    rooted = stored(entries.join(facts.select("class", "root"), "class"), "rooted")
    sizes = rooted.groupBy("gram", "band", "root").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("gram", "band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.max("n").alias("inner"))
    pieces = lambda n: F.ceil(n / PIECE_ROWS).cast("int")
    split = stored(split.where("roots > 1").select("gram", "band", "largest", pieces(F.col("all") - F.col("inner")).alias("n_left"), pieces(F.col("all")).alias("n_right")), "split")
    open_rows = rooted.join(split, ["gram", "band"]).withColumn("outer", F.col("root") != F.col("largest")).join(facts.drop("root"), "class")
    piece = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["gram", "band", "class", "size", "have", "root", "outer", "own", "parity"]
    left = open_rows.where("outer").select(*names, F.lit(False).alias("right"), piece("n_left").alias("i"), every("n_right").alias("j"))
    right = open_rows.select(*names, F.lit(True).alias("right"), every("n_left").alias("i"), piece("n_right").alias("j"))
    return left.unionByName(right)


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, class, size and root (the class that stands for all that it links with, by way of others too) of each row."""
    spark = docs.sparkSession
    who = stored(members(docs, doc_id, text, n), "members")
    blocks = max(shuffles(spark), -(-8 * (who.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES))
    roots = class_components(incidence(docs, text, blocks, n, percent), percent)
    found = who.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    return stored(found, "placed")


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included) and class of each row.

    Texts are lower-cased in A-Z. Two rows link when 100 * common >= percent * all n-grams of both. A text of fewer than n words has its whole
    sequence as its only n-gram; null texts and those without a word have none and link with nothing. Rows that repeat, in id or in text,
    each give a row. A null doc_id is never a component's id unless all in it are null. Other columns play no part. An empty table gives an empty table.
    """
    rows = placed(docs, doc_id, text, n, percent)
    least = rows.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = rows.join(stored(least, "least"), "root", "left")  # stored, so that Spark can split the rows of a large component
    own = F.when(F.col("size") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return both.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), F.col("class"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return linked(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the smallest doc_id, and all rows without a word, with all columns of docs.

    Rows are told apart by id and text, whatever repeats: a null doc_id comes last, and of rows with one id in a component that with the smaller hash stays.
    Of rows that are equal in id and text one stays, unless they are without a word.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, words = F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}").cast("string")
    key = F.xxhash64(own.isNull(), own, words)
    rows = placed(plain.select(F.struct(own.alias("doc_id"), key.alias("key")).alias("doc"), words.alias("text")), "doc", "text").where("size > 0")
    least = F.min(F.struct(F.col("doc_id.doc_id").isNull().alias("last"), F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.key").alias("key")))
    kept = rows.groupBy("root").agg(least.alias("least")).select("least.key")
    spoken = F.coalesce(words.rlike(WORD), F.lit(False))
    # equal rows become one in each task before they are dealt by key, so that no key has many rows; the join goes by the same key
    single = plain.where(spoken).withColumn("key", key).dropDuplicates(["key"]).join(kept, "key", "left_semi").drop("key")
    return single.unionByName(plain.where(~spoken)).select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(names)))


OP7_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from p),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b using (g) where a.doc_id < b.doc_id group by all),
link as (select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id where 100 * o >= 75 * (x.n + y.n - o)),
edge as (select a, b from link union select b, a from link),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) as component_id
from d left join n using (doc_id) left join reach on reach.a = d.doc_id group by d.doc_id, n.n
"""
