"""Scoring of texts by an n-gram model in sharded Elias-Fano tries.

Texts become blocks: files of word numbers and the block's words, so later steps neither read nor split a text again. The model has words,
pairs and triples, all of them, and interpolates by Dirichlet priors:

    P(w)       = (c(w) + 1/2) / (N + (V + 1) / 2)
    P(w | v)   = (c(vw) + PAIR_PRIOR P(w)) / (c(v) + PAIR_PRIOR)
    P(w | u v) = (c(uvw) + TRIPLE_PRIOR P(w | v)) / (c(uv) + TRIPLE_PRIOR)

A shard holds the tries of the words that hash to it. A word (or pair) that is more than a quarter of a mean shard has its pairs (triples) spread over
all shards by their own hash; there are at most 4 such words a shard, and their counts are sent to all tasks. Each block sends each shard of which it has any its
distinct n-grams with the counts of training texts, once; the shard adds them up, builds its trie as a file, maps it into memory, looks up what the
blocks asked for and answers in quantised probabilities. Each block then scores its texts. No n-gram crosses the network more than once a block.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, words
from .langid import held_out
from .tables import place, shuffles, stored, table
from .trie import EliasFano, Trie, probability, quantised, starts_of

PAIR_PRIOR = 3000.0
TRIPLE_PRIOR = 5.0
BLOCK_TOKENS = 1_500_000
SHARD_TOKENS = 1_250_000
#: A word or pair is split if it is more than this part of a mean shard.
SPLIT = 4

#: What stands before a text and after it: no words hash to these but by chance in 2^64.
BEGIN, END = np.uint64(0x62656769), np.uint64(0x656E64)
BITS = np.uint64(32)
#: Words are told apart by 32 bits among the successors of a word, and by 24 among those of a pair: a chance match has the odds of successors / 2^bits.
TRIPLE_SHIFT = 8

_INTS = "<u4"


def _small(a: np.ndarray) -> bytes:
    """Numbers that are mostly small: a byte each, those from 255 on beside them."""
    a = np.asarray(a, np.int64)
    over = a[a >= 255].astype("<u8").tobytes()
    return np.array([len(a), len(over)], "<u8").tobytes() + over + zstandard.compress(np.minimum(a, 255).astype(np.uint8).tobytes(), 1)


def _from_small(data: bytes) -> np.ndarray:
    n, k = np.frombuffer(data, "<u8", 2).tolist()
    out = np.frombuffer(zstandard.decompress(data[16 + k :], max_output_size=max(1, n)), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", k // 8, 16).astype(np.int64)
    return out


@dataclass
class Block:
    """Some texts: words are distinct and ascending; codes number the words of all texts one after the other, each text's end included."""

    doc_ids: list[int | None]
    lengths: np.ndarray
    train: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(doc_ids: list, train: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> "Block":
        """hashes: of the words of all texts; lengths: words of each text."""
        ends = np.cumsum(lengths + 1) - 1
        sequence = np.full(int(lengths.sum()) + len(lengths), END, np.uint64)
        inside = np.ones(len(sequence), bool)
        inside[ends] = False
        sequence[inside] = hashes
        found, codes = np.unique(np.concatenate((sequence, [BEGIN, END])), return_inverse=True)
        return Block(doc_ids, lengths + 1, train, found, codes[:-2].astype(np.int32))

    def to_bytes(self) -> bytes:
        by_use = np.argsort(-np.bincount(self.codes, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(by_use), np.int32)
        rank[by_use] = np.arange(len(by_use), dtype=np.int32)
        planes = np.ascontiguousarray(rank[self.codes].view(np.uint8).reshape(-1, 4).T)
        ids = np.array([0 if x is None else x for x in self.doc_ids], "<i8").tobytes() + np.array([x is None for x in self.doc_ids], np.uint8).tobytes()
        parts = [ids, _small(self.lengths), np.packbits(self.train).tobytes(), self.words[by_use].tobytes(), *(zstandard.compress(p.tobytes(), 1) for p in planes)]
        return np.array([len(self.doc_ids), len(self.codes), *map(len, parts)], "<u8").tobytes() + b"".join(parts)

    @staticmethod
    def from_bytes(data: bytes) -> "Block":
        n, tokens, *sizes = np.frombuffer(data, "<u8", 10).tolist()
        at = np.cumsum([80, *sizes])
        ids, lengths, train, found, *planes = (data[a:b] for a, b in zip(at[:-1], at[1:]))
        doc_ids = [None if gone else x for x, gone in zip(np.frombuffer(ids, "<i8", n).tolist(), ids[8 * n :])]
        by_use = np.frombuffer(found, np.uint64)
        order = np.argsort(by_use)
        code = np.empty(len(order), np.int32)
        code[order] = np.arange(len(order), dtype=np.int32)
        rank = np.stack([np.frombuffer(zstandard.decompress(p, max_output_size=max(1, tokens)), np.uint8) for p in planes], 1).copy().view(np.int32).ravel()
        return Block(doc_ids, _from_small(lengths), np.unpackbits(np.frombuffer(train, np.uint8), count=n).astype(bool), by_use[order], code[rank])

    def firsts(self) -> np.ndarray:
        out = np.zeros(len(self.codes), bool)
        out[np.cumsum(self.lengths) - self.lengths] = True
        return out

    def before(self, first: np.ndarray) -> np.ndarray:
        """The word before each place; BEGIN before the first ones."""
        out = np.empty(len(self.codes), np.int64)
        out[1:] = self.codes[:-1]
        out[first] = np.searchsorted(self.words, BEGIN)
        return out

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def word_counts(self) -> np.ndarray:
        """Of each word, how often training texts have it; BEGIN once for each of them."""
        out = np.bincount(self.codes[self.train[self.doc]], minlength=len(self.words))
        out[np.searchsorted(self.words, BEGIN)] = self.train.sum()
        return out


@dataclass
class Plan:
    """What all tasks know: sizes of the training text and the words and pairs that are spread over shards, ascending, with their counts."""

    tokens: int
    types: int
    shards: int
    split_words: np.ndarray
    split_counts: np.ndarray
    split_pairs: np.ndarray  # rows of two words
    pair_counts: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array([self.tokens, self.types, self.shards]), split_words=self.split_words, split_counts=self.split_counts, split_pairs=self.split_pairs, pair_counts=self.pair_counts)
        return out.getvalue()

    @staticmethod
    def of(data: bytes) -> "Plan":
        with np.load(io.BytesIO(data)) as f:
            return Plan(*f["sizes"].tolist(), f["split_words"], f["split_counts"], f["split_pairs"], f["pair_counts"])

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((words.mix(hashes) >> BITS) * np.uint64(self.shards) >> BITS).astype(np.int32)


def _distinct(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending; where each key is among them; how often each comes with its flag set."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    heads = np.flatnonzero(new)
    return ranked[new], inverse, np.add.reduceat(flags[order], heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)


@dataclass
class Grams:
    """The distinct pairs and triples of a block, and where they go."""

    pair_of: np.ndarray  # of each place of the codes: the pair that ends there
    pairs: np.ndarray  # u * words + v
    pair_counts: np.ndarray
    pair_shard: np.ndarray
    later: np.ndarray  # places that are not the first of a text
    triple_of: np.ndarray  # of each of these: the triple that ends there
    triples: np.ndarray  # pair * words + w
    triple_counts: np.ndarray
    triple_shard: np.ndarray
    word_shard: np.ndarray

    @staticmethod
    def of(b: Block, plan: Plan) -> "Grams":
        n = np.int64(len(b.words))
        first = b.firsts()
        train = b.train[b.doc]
        pairs, pair_of, pair_counts = _distinct(b.before(first) * n + b.codes, train)
        later = np.flatnonzero(~first)
        triples, triple_of, triple_counts = _distinct(pair_of[later - 1] * n + b.codes[later], train[later])

        home = plan.shard(b.words)
        u, v = np.divmod(pairs, n)
        pair_shard = home[u]
        at = np.flatnonzero(np.isin(b.words, plan.split_words)[u])
        hashes = words.chain(b.words[u[at]], b.words[v[at]])
        pair_shard[at] = plan.shard(hashes)
        split = np.isin(hashes, words.chain(plan.split_pairs[:, 0], plan.split_pairs[:, 1])) if len(plan.split_pairs) else np.zeros(len(at), bool)
        parent = triples // n
        triple_shard = pair_shard[parent]
        if split.any():
            hot = np.zeros(len(pairs), bool)
            hot[at[split]] = True
            spread = np.flatnonzero(hot[parent])
            p = parent[spread]
            triple_shard[spread] = plan.shard(words.chain(b.words[u[p]], b.words[v[p]], b.words[triples[spread] - p * n]))
        return Grams(pair_of, pairs, pair_counts, pair_shard, later, triple_of, triples, triple_counts, triple_shard, home)

    def parts(self, n: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard: its words, its pairs (with those that are there for their triples only), which of these are at home, its triples. n: words of the block."""
        cut = lambda s: (o := np.argsort(s, kind="stable"), np.searchsorted(s[o], np.arange(shards + 1)))
        (wo, wc), (po, pc), (to, tc) = cut(self.word_shard), cut(self.pair_shard), cut(self.triple_shard)
        for s in range(shards):
            w, p, t = wo[wc[s] : wc[s + 1]], po[pc[s] : pc[s + 1]], to[tc[s] : tc[s + 1]]
            parent = self.triples[t] // n
            guests = np.unique(parent[self.pair_shard[parent] != s])
            both = np.sort(np.concatenate((p, guests))) if len(guests) else p
            yield s, w, both, self.pair_shard[both] == s, t


MESSAGE = "shard int, name string, words binary, word_counts binary, degrees binary, others binary, other_degrees binary, pairs binary, pair_counts binary, home binary, children binary, triples binary, triple_counts binary"
REPLY = "name string, shard int, words binary, pairs binary, rests binary, triples binary"


def _message(b: Block, g: Grams, counts: np.ndarray, name: str, plan: Plan) -> Iterator[tuple]:
    n = len(b.words)
    prints = (b.words >> BITS).astype(_INTS)
    for s, w, p, home, t in g.parts(n, plan.shards):
        if not len(w) and not len(p) and not len(t):
            continue
        u, v = np.divmod(g.pairs[p], n)
        head = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, int)
        context, degree = u[head], np.diff(np.concatenate((head, [len(u)])))
        own = g.word_shard[context] == s
        degrees = np.zeros(len(w), np.int64)
        degrees[np.searchsorted(w, context[own])] = degree[own]
        parent, last = np.divmod(g.triples[t], n)
        children = np.bincount(np.searchsorted(p, parent), minlength=len(p))
        yield (
            s, name, b.words[w].tobytes(), _small(counts[w]), _small(degrees), b.words[context[~own]].tobytes(), _small(degree[~own]), prints[v].tobytes(), _small(g.pair_counts[p]),
            np.packbits(home).tobytes(), _small(children), (prints[last] >> TRIPLE_SHIFT).astype(_INTS).view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), _small(g.triple_counts[t]),
        )


def _three_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view(_INTS).ravel()


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where each key is among them, and their summed counts."""
    return _distinct(keys, counts)


def _mapped(data: bytes) -> Trie:
    """A trie as a memory-mapped file, which goes when the trie does."""
    with tempfile.NamedTemporaryFile(prefix="trie-", delete=False) as f:
        f.write(data)
    try:
        return Trie.mapped(f.name)
    finally:
        os.unlink(f.name)


def _shard_data(t: pa.Table) -> dict[str, object]:
    """The messages of a shard, one after the other: distinct words, pairs and triples with their counts, and where each message's are among them."""
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    size = lambda parts: np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    cell = lambda c: (x.as_py() for x in t[c])
    asked = [np.frombuffer(x, np.uint64) for x in cell("words")]
    pairs, triples = [np.frombuffer(x, _INTS) for x in cell("pairs")], [_three_bytes(x) for x in cell("triples")]
    home = join((np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(cell("home"), pairs)), bool)
    contexts = []
    for own, degrees, others, other_degrees in zip(asked, map(_from_small, cell("degrees")), cell("others"), map(_from_small, cell("other_degrees"))):
        hashes, n = np.concatenate((own[degrees > 0], np.frombuffer(others, np.uint64))), np.concatenate((degrees[degrees > 0], other_degrees))
        order = np.argsort(hashes)
        contexts.append(np.repeat(hashes[order], n[order]))
    word, word_at, word_n = _merged(join(asked, np.uint64), join(map(_from_small, cell("word_counts")), np.int64))
    context = join(contexts, np.uint64)
    names = np.union1d(word, context)
    key = np.searchsorted(names, context).astype(np.uint64) << BITS | join(pairs, _INTS).astype(np.uint64)
    pair, pair_at, pair_n = _merged(key, np.where(home, join(map(_from_small, cell("pair_counts")), np.int64), 0))
    key = np.repeat(pair_at.astype(np.uint64), join(map(_from_small, cell("children")), np.int64)) << BITS | join(triples, _INTS).astype(np.uint64)
    triple, triple_at, triple_n = _merged(key, join(map(_from_small, cell("triple_counts")), np.int64))
    return {"names": names, "word": word, "word_at": word_at, "word_n": word_n, "pair": pair, "pair_at": pair_at, "pair_n": pair_n, "home": home, "triple": triple, "triple_at": triple_at, "triple_n": triple_n,
            "cuts": [size(x) for x in (asked, pairs, triples)], "message": list(cell("name"))}


def build(d: dict, plan: Plan) -> Trie:
    """The trie of a shard, of the n-grams that training texts have."""
    low = np.uint64(0xFFFFFFFF)
    total = np.zeros(len(d["names"]), np.int64)
    total[np.searchsorted(d["names"], d["word"])] = d["word_n"]
    wide = np.isin(plan.split_words, d["names"])
    total[np.searchsorted(d["names"], plan.split_words[wide])] = plan.split_counts[wide]
    pair_total = d["pair_n"].copy()
    if len(plan.split_pairs):
        here = np.isin(plan.split_pairs[:, 0], d["names"])
        key = np.searchsorted(d["names"], plan.split_pairs[here, 0]).astype(np.uint64) << BITS | plan.split_pairs[here, 1] >> BITS
        there = np.isin(key, d["pair"])
        pair_total[np.searchsorted(d["pair"], key[there])] = plan.pair_counts[here][there]
    keep_w, keep_p = total > 0, pair_total > 0
    keep_t = d["triple_n"] > 0
    word_rank, pair_rank = np.cumsum(keep_w) - 1, np.cumsum(keep_p) - 1
    context = (d["pair"] >> BITS).astype(np.int64)
    parent = (d["triple"] >> BITS).astype(np.int64)[keep_t]
    share = np.where(d["pair_n"] > 0, d["pair_n"], 1e-9)[keep_p] / (total[context[keep_p]] + PAIR_PRIOR)
    return Trie(
        words=EliasFano.of(d["names"][keep_w], 1 << 64), counts=total[keep_w],
        pair_starts=starts_of(word_rank[context[keep_p]], int(keep_w.sum())), pairs=(d["pair"][keep_p] & low).astype(_INTS),
        pair_p=quantised(share), rest=quantised(TRIPLE_PRIOR / (pair_total[keep_p] + TRIPLE_PRIOR)),
        triple_starts=starts_of(pair_rank[parent], int(keep_p.sum())), triples=(d["triple"][keep_t] & low).astype(_INTS),
        triple_p=quantised(d["triple_n"][keep_t] / (pair_total[parent] + TRIPLE_PRIOR)),
    )


def answers(d: dict, trie: Trie) -> pa.Table:
    """What the trie says of each n-gram that was asked for, by message."""
    low = np.uint64(0xFFFFFFFF)
    node = trie.find_words(d["names"])
    counts = np.where(node >= 0, trie.counts[node], 0) if len(trie.counts) else np.zeros(len(node), np.int64)
    none = lambda found, values, other: np.where(found >= 0, values[found], np.uint16(other)) if len(values) else np.full(len(found), other, np.uint16)
    pair = trie.find_pairs(node[(d["pair"] >> BITS).astype(np.int64)], (d["pair"] & low).astype(_INTS))
    triple = trie.find_triples(pair[(d["triple"] >> BITS).astype(np.int64)], (d["triple"] & low).astype(_INTS))
    word_out = counts[np.searchsorted(d["names"], d["word"])][d["word_at"]]
    pair_p, rest = none(pair, trie.pair_p, 0xFFFF)[d["pair_at"]], none(pair, trie.rest, 0)[d["pair_at"]]
    triple_p = none(triple, trie.triple_p, 0xFFFF)[d["triple_at"]]
    press = lambda x: zstandard.compress(np.ascontiguousarray(x.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes(), 1)
    (w, p, t), home = d["cuts"], d["home"]
    rows = []
    for k, name in enumerate(d["message"]):
        at = slice(p[k], p[k + 1])
        rows.append((name, _small(word_out[w[k] : w[k + 1]]), press(pair_p[at][home[at]]), press(rest[at][home[at]]), press(triple_p[t[k] : t[k + 1]])))
    columns = list(zip(*rows)) or [()] * 5
    return pa.table({k: pa.array(c, pa.string() if k == "name" else pa.binary()) for k, c in zip(("name", "words", "pairs", "rests", "triples"), columns)})


def _codes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint16)
    return np.frombuffer(zstandard.decompress(data, max_output_size=2 * n), np.uint8).reshape(2, n).T.copy().view("<u2").ravel()


def blocks(docs: DataFrame, uri: str) -> DataFrame:
    """Writes the columns doc_id, train and text of docs as blocks in the folder uri: name, tokens, train_tokens and train_docs of each."""
    store.make_dir(uri)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, hashes, lengths, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, train, hashes, lengths, held
            b = Block.of(ids, np.concatenate(train), np.concatenate(hashes), np.concatenate(lengths))
            name = f"{uuid.uuid4().hex}.block"  # the attempt that counts is the one whose row is kept
            store.commit(uri, name, b.to_bytes())
            ids, train, hashes, lengths, held = [], [], [], [], 0
            row = [name, len(b.codes), int(b.lengths[b.train].sum()), int(b.train.sum())]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["name", "tokens", "train_tokens", "train_docs"])

        for batch in batches:
            all_ids, flags = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for g in words.groups(batch.column(2)):
                ids += all_ids[g.first : g.first + g.n_docs]
                train.append(flags[g.first : g.first + g.n_docs])
                hashes.append(g.hashes())
                lengths.append(words.per_doc(None, g.doc, g.n_docs))
                held += len(hashes[-1]) + g.n_docs
                if held >= BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return stored(docs.select("doc_id", "train", "text").mapInArrow(run, "name string, tokens long, train_tokens long, train_docs long"), "blocks")


def _each(found: DataFrame, uri: str, work, schema: str) -> DataFrame:
    """work(block, name) gives rows for each block, a task for each."""
    kinds = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    names, types = zip(*(x.split() for x in schema.split(", ")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = list(work(Block.from_bytes(_read(uri, name)), name))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, types)], list(names))

    return found.select("name").repartition(max(1, found.count())).mapInArrow(run, schema)


def _read(uri: str, name: str) -> bytes:
    fs, path = store.opened(uri)
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read()


def planned(found: DataFrame, uri: str) -> Plan:
    """Counts the words of the blocks. What reaches the driver are sums of each shard and words and pairs over the bound: at most SPLIT of each a shard."""
    spark = found.sparkSession
    tokens, train = (x or 0 for x in found.agg(F.sum("tokens"), F.sum("train_tokens")).first())
    shards = max(shuffles(spark), -(-tokens // SHARD_TOKENS))
    bound = max(1, train // (SPLIT * shards))
    start = Plan(train, 0, shards, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))

    def send(b: Block, name: str) -> Iterator[tuple]:
        counts, home = b.word_counts(), start.shard(b.words)
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(shards + 1))
        for s in range(shards):
            at = order[cut[s] : cut[s + 1]]
            at = at[counts[at] > 0]
            if len(at):
                yield s, b.words[at].tobytes(), _small(counts[at])

    def add(t: pa.Table) -> pa.Table:
        word = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t["words"]])
        word, _, n = _merged(word, np.concatenate([_from_small(x.as_py()) for x in t["counts"]]))
        many = n >= bound
        rows = [int((word != BEGIN).sum()), word[many].tobytes(), n[many].astype("<i8").tobytes()]
        return pa.table({k: pa.array([x]) for k, x in zip(("types", "words", "counts"), rows)})

    sums = _each(found, uri, send, "shard int, words binary, counts binary").groupBy("shard").applyInArrow(add, "types long, words binary, counts binary").collect()
    many = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in sums)])
    times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in sums)])
    order = np.argsort(many)
    many, times = many[order], times[order]

    def both(b: Block, name: str) -> Iterator[tuple]:
        wide = np.isin(b.words, many)
        before = b.before(b.firsts())
        at = wide[before] & wide[b.codes] & b.train[b.doc]
        key, n = np.unique(before[at] * len(b.words) + b.codes[at], return_counts=True)
        u, v = np.divmod(key, len(b.words))
        yield from zip(b.words[u].view(np.int64).tolist(), b.words[v].view(np.int64).tolist(), n.tolist())

    pairs = _each(found, uri, both, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).collect() if len(many) else []
    two = np.array([[r["u"], r["v"]] for r in pairs], np.int64).reshape(-1, 2).view(np.uint64)
    return Plan(train, sum(r["types"] for r in sums), shards, many, times, two, np.array([r["n"] for r in pairs], np.int64))


def scored(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row, by a model of the rows where train holds.

    Texts are lower-cased in A-Z; tokens are their words and one end. Null and empty texts are an end alone. Scores are log10
    probabilities of the whole text; base_score is that of single words. A word that no training text has counts as the one unknown word.
    Rows that repeat give a row each and count as often as they come; a null in train counts as false; doc_id has to be a number or null. Other columns play
    no part. An empty table gives an empty table, and no row to train on gives the probabilities of an empty model.
    """
    uri = place(docs.sparkSession, "lm-blocks")
    found = blocks(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text}`").cast("string").alias("text")), uri)
    plan = planned(found, uri)
    return _scores(found, uri, plan, None)


def fitted(docs: DataFrame, model: str, text: str = "text") -> None:
    """Learns a model from all texts of docs and keeps it in the folder model, which must be new: a file for each shard's trie, and the plan, which is written last and so says that it is whole."""
    uri = place(docs.sparkSession, "lm-blocks")
    found = blocks(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("train"), F.col(f"`{text}`").cast("string").alias("text")), uri)
    plan = planned(found, uri)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    store.make_dir(model)

    def keep(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        store.commit(model, _trie_name(shard), build(_shard_data(t), shared.value).to_bytes())
        return pa.table({"shard": pa.array([shard], pa.int32())})

    messages = _each(found, uri, lambda b, name: _message(b, Grams.of(b, shared.value), b.word_counts(), name, shared.value), MESSAGE)
    messages.groupBy("shard").applyInArrow(keep, "shard int").write.format("noop").mode("overwrite").save()
    store.commit(model, PLAN, plan.to_bytes())


def score_with(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``scored`` for all rows of docs, by a kept model; nothing is learned from them. Nulls, repeated rows and empty tables are as there."""
    uri = place(docs.sparkSession, "lm-blocks")
    found = blocks(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.lit(False).alias("train"), F.col(f"`{text}`").cast("string").alias("text")), uri)
    plan = Plan.of(_read(model, PLAN))
    fs, path = store.opened(model)
    kept = {x.base_name for x in fs.get_file_info(pafs.FileSelector(path))}  # a name a shard
    bare = build(dict.fromkeys(("names", "word", "pair", "triple"), np.zeros(0, np.uint64)) | dict.fromkeys(("word_n", "pair_n", "triple_n"), np.zeros(0, np.int64)), plan).to_bytes()
    return _scores(found, uri, plan, lambda shard: _read(model, _trie_name(shard)) if _trie_name(shard) in kept else bare)


#: The file of a kept model that says what its tries have been built by.
PLAN = "plan.npz"


def _trie_name(shard: int) -> str:
    return f"shard-{shard:06d}.trie"


def _scores(found: DataFrame, uri: str, plan: Plan, kept: Callable[[int], bytes] | None) -> DataFrame:
    """Scores of the texts in blocks; kept gives the trie of a shard, which else is built from what the blocks send."""
    shared = found.sparkSession.sparkContext.broadcast(plan)  # at most SPLIT words and pairs for each shard

    def ask(b: Block, name: str) -> Iterator[tuple]:
        return _message(b, Grams.of(b, shared.value), b.word_counts(), name, shared.value)

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        d, shard = _shard_data(t), key[0].as_py()
        out = answers(d, _mapped(kept(shard) if kept else build(d, shared.value).to_bytes()))
        return out.add_column(1, "shard", pa.array([shard] * out.num_rows, pa.int32()))

    def score(key: tuple, t: pa.Table) -> pa.Table:
        plan, b = shared.value, Block.from_bytes(_read(uri, key[0].as_py()))
        g = Grams.of(b, plan)
        counts = np.zeros(len(b.words), np.int64)
        pair_p, rest, triple_p = np.zeros(len(g.pairs)), np.ones(len(g.pairs)), np.zeros(len(g.triples))
        reply = {s: i for i, s in enumerate(t["shard"].to_pylist())}
        for s, w, p, home, k in g.parts(len(b.words), plan.shards):
            if s not in reply:  # nothing was asked
                continue
            p = p[home]
            cell = lambda c: t[c][reply[s]].as_py()  # noqa: B023, E731
            counts[w] = _from_small(cell("words"))
            pair_p[p], rest[p] = probability(_codes(cell("pairs"), len(p))), probability(_codes(cell("rests"), len(p)))
            triple_p[k] = probability(_codes(cell("triples"), len(k)))
        one = (counts + 0.5) / (plan.tokens + 0.5 * (plan.types + 1))
        u, v = np.divmod(g.pairs, len(b.words))
        two = pair_p + PAIR_PRIOR / (counts[u] + PAIR_PRIOR) * one[v]
        whole = two[g.pair_of]
        whole[g.later] = triple_p[g.triple_of] + rest[g.pair_of[g.later - 1]] * whole[g.later]
        sums = lambda x: np.bincount(b.doc, weights=x, minlength=len(b.lengths))
        return pa.table({
            "doc_id": pa.array(b.doc_ids, pa.int64()), "n_tokens": pa.array(b.lengths, pa.int64()), "n_known": pa.array(sums(counts[b.codes] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(b.lengths), plan.tokens, np.int64)), "base_score": pa.array(sums(np.log10(one)[b.codes])), "score": pa.array(sums(np.log10(whole))),
        })

    replies = _each(found, uri, ask, MESSAGE).groupBy("shard").applyInArrow(answer, REPLY)
    return replies.groupBy("name").applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of four of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 1)
    found = scored(docs, ~out)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
