"""Sets of words that are nearly those of a better ranked text: an exact join that is compared inside tasks and writes no pair.

1. Words become 64-bit hashes, another seed's if two words of the texts have one hash, so sets of hashes are alike exactly as sets of words are.
2. Each text's set is written once, to files of the shared folder, by bands of size: sets that are alike are of one band or of neighbours. Beside a set are its first words in an order
   of all words, rare ones first, and the parities of its hashes, folded to about as many bits as it has words.
3. Of equal sets the best ranked is compared on behalf of all.
4. Groups of files' bands have bounded sizes. A task reads two groups from the shared folder at a time. Sets meet by a word that is among the first of both. If it is the first
   that they share, what follows it in either bounds what they share (Xiao et al., 2008: positional filter). Who still can be alike is ruled out by parities, as sets differ
   in as many words as bits at least, or compared word by word.
5. A set that has been found to be alike to a better one is compared no more. It first meets the best ranked set of each word, so large groups of near copies take one comparison a set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.lineage import place, stored
from .index import _small_batches

#: Words that a task gathers before it writes a file of sets, and rows at most.
WORDS, ROWS = 1 << 20, 1 << 19
#: Words of the sets of a group, one file's band beyond that.
GROUP = 1 << 22
#: Words whose frequency is known in the order of words, at most; others are rarer than each of them.
FREQUENT = 1 << 18
#: First words, and pairs by them, that a task looks at in one step, and bytes of parities.
MEETS, STEP_BYTES = 1 << 17, 1 << 23
#: The least bits of parities.
BITS = 512
#: Bits of a size and of a place in the order of words, within an item's key. Larger sizes count as the largest.
SIZE, CODE = 20, 44
LARGEST = (1 << SIZE) - 1


def hashed(word: Column, seed: int) -> Column:
    return F.xxhash64(word, F.lit(seed))


def needed(n, m, percent: int):
    """Words that sets of n and m words share at least if they are alike to percent."""
    return -(-percent * (n + m) // (100 + percent))


def firsts(n, percent: int):
    """How many of a set's n words, in the order of all words, the first that it shares with a set it is alike to can be among."""
    return 1 + n - needed(n, -(-percent * n // 100), percent)


def edges(largest: int, percent: int) -> np.ndarray:
    """The least sizes of bands, beyond the largest: a set is alike to those of its own band and of the next ones up and down only."""
    found = [1]
    while found[-1] <= largest:
        found.append(100 * found[-1] // percent + 1)
    return np.array(found, np.int64)


def bits_of(band: int, percent: int) -> int:
    """Bits of the parities of a band, a power of two."""
    size = 1
    for _ in range(band + 1):
        size = 100 * size // percent + 1
    return max(BITS, 1 << (size - 1).bit_length())


@dataclass(frozen=True)
class Order:
    """Hashes of frequent words, sorted, and the place of each by frequency."""

    hashes: np.ndarray
    places: np.ndarray

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Where hashes stand in the order of words. Rare words may share a place: they only meet in vain."""
        rare = words >> np.uint64(65 - CODE)
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.places[at] + np.uint64(1 << CODE - 1), rare)


def words_of(texts: DataFrame, text: str) -> tuple[int, Order]:
    """A seed that gives all words of the texts different hashes, and the order of words.

    The words whose frequency is known are those of the highest classes (a quarter of a power of two) that have FREQUENT words at most together.
    """
    counted = stored(texts.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    seed = 42
    while counted.groupBy(hashed(F.col("word"), seed)).agg(F.count(F.lit(1)).alias("words")).where("words > 1").limit(1).count():
        seed += 1
    level = F.floor(4 * F.log2("n"))
    least, total = None, 0
    for at, words in sorted(map(tuple, counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True):
        total += words
        if total > FREQUENT:
            break
        least = at
    if least is None:
        return seed, Order(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    top = counted.where(level >= least).select(hashed(F.col("word"), seed).alias("hash"), "n").toArrow()
    hashes, n = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    places = np.empty(len(n), np.uint64)
    places[np.lexsort((hashes, n))] = np.arange(len(n), dtype=np.uint64)
    by = np.argsort(hashes)
    return seed, Order(hashes[by], places[by])


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def _write(uri: str, name: str, parts: Iterable[np.ndarray]) -> None:
    """Whole under a temporary name, then renamed."""
    fs, path = _opened(uri)
    temp = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}.tmp"
    with fs.open_output_stream(temp) as out:
        for part in parts:
            out.write(pa.py_buffer(np.ascontiguousarray(part)))
    fs.move(temp, f"{path}/{name}")


def parities(words: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """A row of longs for each of sets of n words that follow each other: of each value of a hash's low bits, whether an odd number of words have it."""
    starts, step = np.append(0, np.cumsum(n)), max(1, (1 << 22) // bits)
    out = np.zeros((len(n), bits // 64), np.uint64)
    for a in range(0, len(n), step):
        b = min(len(n), a + step)
        values = (words[starts[a] : starts[b]] & np.uint64(bits - 1)).astype(np.int64) + np.repeat(np.arange(b - a), n[a:b]) * bits
        odd = (np.bincount(values, minlength=(b - a) * bits) & 1).astype(np.uint8)
        out[a:b] = np.packbits(odd).view(np.uint64).reshape(b - a, bits // 64)
    return out


def folded(longs: np.ndarray, bits: int) -> np.ndarray:
    """Parities of fewer bits, a power of two."""
    while longs.shape[1] * 64 > bits:
        half = longs.shape[1] // 2
        longs = longs[:, :half] ^ longs[:, half:]
    return longs


def _segment(words: np.ndarray, n: np.ndarray, bits: int, order: Order, percent: int) -> list[np.ndarray]:
    """Sets of one band as they are written: sizes, words, parities, and of the first words keys in their order, rows and places."""
    starts = np.cumsum(n) - n
    rows = np.repeat(np.arange(len(n)), n)
    codes = np.sort(rows.astype(np.uint64) << np.uint64(CODE) | order.codes(words))  # of a set after those of sets before, so rows stay as they are
    places = np.arange(len(words)) - starts[rows] + 1
    first = places <= firsts(n, percent)[rows]
    keys = (codes[first] & np.uint64((1 << CODE) - 1)) << np.uint64(SIZE) | np.minimum(n, LARGEST)[rows[first]].astype(np.uint64)
    by = np.argsort(keys)
    return [n.astype(np.int64), words, parities(words, n, bits), keys[by], rows[first][by].astype(np.int32), places[first][by].astype(np.int32)]


SETS = "digest binary, file string, row long, band int, n long, items long"


def _sets(path: str, key: str, order: Order, percent: int, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the sets of rows of key and hashes (repeated ones count once), about most words a file, and gives each row's digest and where its set is."""

    def write(keys: list[pa.Array], sets: list[np.ndarray], name: str) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        band = np.searchsorted(edges(int(n.max(initial=0)), percent), n, "right") - 1
        by = np.argsort(band, kind="stable")
        parts: list[np.ndarray] = []
        for k in np.unique(band[band >= 0]):
            own = np.flatnonzero(band == k)
            parts += _segment(np.concatenate([sets[i] for i in own]), n[own], bits_of(int(k), percent), order, percent)
        _write(path, name, parts)
        rows = np.empty(len(n), np.int64)
        rows[by] = np.arange(len(n)) - (band < 0).sum()
        digests = pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), digests, pa.array([name] * len(n), pa.string()), pa.array(rows), pa.array(band.astype(np.int32)), pa.array(n), pa.array(firsts(n, percent))], [key, *(c.split()[0] for c in SETS.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, total, files, task = [], [], 0, 0, TaskContext.get()
        name = lambda: f"sets-{task.partitionId()}-{task.taskAttemptId()}-{files}"
        for batch in batches:
            lists = batch.column(1)
            upto, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            since = 0
            for i in range(batch.num_rows):
                sets.append(np.unique(values[upto[i] : upto[i + 1]]))
                total += len(sets[-1])
                if total >= most or len(sets) >= ROWS:
                    yield write([*keys, batch.column(0).slice(since, i + 1 - since)], sets, name())
                    keys, sets, total, files, since = [], [], 0, files + 1, i + 1
            if since < batch.num_rows:
                keys.append(batch.column(0).slice(since))
        if sets:
            yield write(keys, sets, name())

    return run


def _ranks(path: str) -> Callable[[pa.Table], pa.Table]:
    """Writes the rows of a file that are compared, and the rank of each."""

    def run(rows: pa.Table) -> pa.Table:
        file, row, best = rows["file"][0].as_py(), rows["row"].to_numpy(), rows["best"].to_numpy()
        by = np.argsort(row)
        _write(path, f"{file}.ranks", [row[by].astype(np.int64), best[by].astype(np.int64)])
        return pa.table({"file": pa.array([file]), "rows": pa.array([len(row)], pa.int64())})

    return run


@dataclass
class Group:
    """Sets of one band, of several files. words are sorted within a set; keys are sorted, with the row and the place of each."""

    file: np.ndarray
    row: np.ndarray
    best: np.ndarray
    n: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    parities: np.ndarray
    keys: np.ndarray
    of: np.ndarray
    places: np.ndarray
    open: np.ndarray

    def set(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i] + self.n[i]]


def _read(path: str, segments: list[tuple], percent: int) -> Group:
    """The sets of segments (file, band, offset in bytes, first row, rows, words, items) that are compared."""
    fs, at = _opened(path)
    parts: list[list[np.ndarray]] = []
    all_words, total, upto = np.empty(sum(s[5] for s in segments), np.uint64), 0, 0
    for k, (file, band, offset, base, rows, words, items) in enumerate(segments):
        with fs.open_input_file(f"{at}/{file}.ranks") as f:
            kept, best = np.frombuffer(f.read(), np.int64).reshape(2, -1)
        a, b = np.searchsorted(kept, (base, base + rows))
        kept, best = kept[a:b] - base, best[a:b].copy()
        longs = bits_of(band, percent) // 64
        sizes = _sizes(rows, words, items, longs)
        with fs.open_input_file(f"{at}/{file}") as f:
            f.seek(offset)
            data = f.read(sum(sizes))
        starts = np.cumsum(sizes) - sizes
        n, w, par, keys, of, places = (np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at) for kind, size, at in zip((np.int64, np.uint64, np.uint64, np.uint64, np.int32, np.int32), sizes, starts.tolist()))
        new = np.full(rows, -1, np.int32)
        new[kept] = np.arange(total, total + len(kept))
        in_kept = new >= 0
        w, item = w[np.repeat(in_kept, n)], in_kept[of]
        all_words[upto : upto + len(w)] = w
        parts.append([np.full(len(kept), k, np.int32), kept + base, best, n[in_kept], par.reshape(rows, longs)[in_kept], keys[item], new[of[item]], places[item]])
        total, upto = total + len(kept), upto + len(w)
    file, row, best, n, par, keys, of, places = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:
        by = np.argsort(keys)
        keys, of, places = keys[by], of[by], places[by]
    return Group(file, row, best, n, np.cumsum(n) - n, all_words[:upto], par, keys, of, places, np.ones(len(n), bool))


def _sizes(rows: int, words: int, items: int, longs: int) -> list[int]:
    """Bytes of the arrays of a segment."""
    return [8 * rows, 8 * words, 8 * longs * rows, 8 * items, 4 * items, 4 * items]


def _alike(a: Group, b: Group, x: np.ndarray, y: np.ndarray, pa_: np.ndarray, pb: np.ndarray, percent: int) -> None:
    """Compares those of the pairs of rows x of a and y of b that parities don't rule out, and closes rows of a that are alike to one."""
    step, left = max(1, STEP_BYTES // (8 * pa_.shape[1])), []
    for s in range(0, len(x), step):
        x_, y_ = x[s : s + step], y[s : s + step]
        both = a.n[x_] + b.n[y_]
        differ = np.bitwise_count(pa_[x_] ^ pb[y_]).sum(1, dtype=np.int64)
        may = differ <= both - 2 * needed(both, 0, percent)
        left.append(x_[may].astype(np.int64) * len(b.n) + y_[may])
    x, y = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *left])), len(b.n))
    by = np.lexsort((b.best[y], x))
    for i, j in zip(x[by].tolist(), y[by].tolist()):
        if a.open[i]:
            few, many = a.set(i), b.set(j)
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            common = int((many[at] == few).sum())
            a.open[i] = 100 * common < percent * (len(few) + len(many) - common)


def compare(a: Group, b: Group, percent: int, step: int) -> None:
    """Closes the rows of a that are alike to a better ranked one of b. Looks at about step pairs at a time."""
    if not len(a.n) or not len(b.n):
        return
    bits = 64 * min(a.parities.shape[1], b.parities.shape[1])
    pa_, pb = folded(a.parities, bits), folded(b.parities, bits)
    # the best ranked row of each word
    codes = b.keys >> np.uint64(SIZE)
    new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    by_rank = np.argsort(b.best, kind="stable").astype(np.int32)
    order = np.empty(len(by_rank), np.int32)
    order[by_rank] = np.arange(len(by_rank))
    hubs, codes = by_rank[np.minimum.reduceat(order[b.of], new)], codes[new]
    for s in range(0, len(a.keys), step):
        own, x = a.keys[s : s + step] >> np.uint64(SIZE), a.of[s : s + step]
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        y = hubs[at]
        can = (codes[at] == own) & a.open[x] & (b.best[y] < a.best[x])
        x, y = x[can], y[can]
        can = 100 * np.minimum(a.n[x], b.n[y]) >= percent * np.maximum(a.n[x], b.n[y])
        _alike(a, b, x[can], y[can], pa_, pb, percent)
    del codes, new, hubs
    # all pairs of those that are left
    for s in range(0, len(a.keys), step):
        item = np.flatnonzero(a.open[a.of[s : s + step]]) + s
        n, own = a.n[a.of[item]], a.keys[item] >> np.uint64(SIZE) << np.uint64(SIZE)
        least, most = -(-percent * n // 100), (100 + percent) * (n - a.places[item] + 1) // percent - n
        low = np.searchsorted(b.keys, own | np.minimum(least, LARGEST).astype(np.uint64))
        high = np.searchsorted(b.keys, own | np.clip(most, 0, LARGEST).astype(np.uint64), "right")
        item, low, many = item[high > low], low[high > low], (high - low)[high > low]
        upto, e = np.append(0, np.cumsum(many)), 0
        while e < len(item):
            f, e = e, max(e + 1, int(np.searchsorted(upto, upto[e] + step, "right")) - 1)
            left = np.flatnonzero(a.open[a.of[item[f:e]]]) + f
            t = np.repeat(left, many[left])
            k = np.arange(len(t)) - np.repeat(np.cumsum(many[left]) - many[left], many[left]) + low[t]
            x, y = a.of[item[t]], b.of[k]
            can = (b.best[y] < a.best[x]) & (b.n[y] - b.places[k] + 1 >= needed(a.n[x], b.n[y], percent))
            _alike(a, b, x[can], y[can], pa_, pb, percent)


def _tiles(path: str, groups: list[list[tuple]], tasks: list[list[tuple[int, int]]], percent: int, step: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the groups of each task (a number), two at a time, and gives the rows that are alike to a better one."""

    def worse(g: Group, segments: list[tuple]) -> pa.RecordBatch:
        closed = np.flatnonzero(~g.open)
        return pa.RecordBatch.from_arrays([pa.array([segments[k][0] for k in g.file[closed].tolist()], pa.string()), pa.array(g.row[closed])], ["file", "row"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for i, j in tasks[task]:
                    a = _read(path, groups[i], percent)
                    if i == j:
                        compare(a, a, percent, step)
                        yield worse(a, groups[i])
                        continue
                    b = _read(path, groups[j], percent)
                    compare(a, b, percent, step)
                    compare(b, a, percent, step)
                    yield worse(a, groups[i])
                    yield worse(b, groups[j])

    return run


def _dealt(segments: list[tuple], lots: int) -> tuple[list[list[tuple]], list[list[tuple[int, int]]]]:
    """Groups of segments (with their words that are compared last), and tasks: pairs of groups that are of one band or of neighbours, in about as many lots, the largest first."""
    groups, sizes, of_band = [], [], {}
    for *segment, compared in sorted(segments, key=lambda s: (s[1], s[0])):
        own = of_band.setdefault(segment[1], [])
        if not own or sizes[own[-1]] + compared > GROUP:
            own.append(len(groups))
            groups.append([])
            sizes.append(0)
        groups[own[-1]].append(tuple(segment))
        sizes[own[-1]] += compared
    pairs = [(i, j) for band, own in of_band.items() for k, i in enumerate(own) for j in [*own[k:], *of_band.get(band + 1, [])]]
    cost = lambda p: sizes[p[0]] + sizes[p[1]]
    most, tasks, held = min(2 * GROUP, sum(map(cost, pairs)) // lots + 1), [], 0
    for p in sorted(pairs, key=cost, reverse=True):
        if not tasks or held + cost(p) > most:
            tasks.append([])
            held = 0
        tasks[-1].append(p)
        held += cost(p)
    return groups, tasks


def unlike(results: DataFrame, texts: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Results (rank, key) that are alike to percent to no better ranked one. texts: rows of key and text, those of the results at least.

    What is written grows with the texts: 8 bytes a word and some 4 for first words.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent: {percent}")
    spark = results.sparkSession
    seed, order = words_of(texts, text)
    path = place(spark, "alike")
    fs, at = _opened(path)
    fs.create_dir(at, recursive=True)
    kind = dict(texts.dtypes)[key]
    with _small_batches(spark):
        hashes = texts.select(key, F.transform(tokens(F.col(text)), lambda w: hashed(w, seed)).alias("words"))
        sets = stored(hashes.mapInArrow(_sets(path, key, order, percent, WORDS), f"`{key}` {kind}, {SETS}"), "sets")
    rows = results.join(sets, key)
    best = stored(rows.groupBy("digest").agg(F.min("rank").alias("best"), F.min(F.struct("file", "row", "band", "n")).alias("at")).select("digest", "best", "at.*"), "best")
    compared = best.where("band >= 0")
    ranks = compared.groupBy("file").applyInArrow(_ranks(path), "file string, rows long")
    stored(ranks, "ranks").count()
    found = sets.where("band >= 0").groupBy("file", "band").agg(F.min("row"), F.count(F.lit(1)), F.sum("n"), F.sum("items")).collect()
    used = {(r.file, r.band): r.words for r in compared.groupBy("file", "band").agg(F.sum("n").alias("words")).collect()}
    segments, offset, last = [], 0, None
    for file, band, base, count, words, first in sorted(map(tuple, found)):
        offset = offset if file == last else 0
        if (file, band) in used:
            segments.append((file, band, offset, base, count, words, first, used[file, band]))
        offset += sum(_sizes(count, words, first, bits_of(band, percent) // 64))
        last = file
    groups, tasks = _dealt(segments, 4 * spark.sparkContext.defaultParallelism)
    worse = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(_tiles(path, groups, tasks, percent, MEETS), "file string, row long")
    kept = best.join(stored(worse, "worse").distinct(), ["file", "row"], "left_anti").select("digest", F.col("best").alias("rank"))
    return rows.join(kept, ["digest", "rank"], "left_semi").select(*results.columns)
