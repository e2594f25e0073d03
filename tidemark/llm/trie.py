"""An n-gram trie of three levels in a few flat arrays of one file, to be memory-mapped.

A level holds the words that follow each node of the level above: fingerprints of words, ascending among the
successors of one node, so a word is found by a successor search within its context's range alone. Where a
node's successors begin is a monotone sequence, kept in Elias-Fano form. With each node go quantised probabilities.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _x in range(256):
    for _k, _b in enumerate([i for i in range(8) if _x >> i & 1]):
        _SELECT[_x, _k] = _b


@dataclass
class EliasFano:
    """A non-decreasing sequence of n numbers below 2^64: the low bits of each packed, the high ones as a unary bit vector."""

    n: int
    low_bits: int
    low: np.ndarray  # 64-bit words
    high: np.ndarray  # 64-bit words
    ranks: np.ndarray  # ones before each word of high

    @staticmethod
    def of(values: np.ndarray, bound: int) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (bound // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift > np.uint64(64 - bits)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(place[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64)
        return EliasFano(n, bits, low, high, np.cumsum(ones) - ones)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ranks, i, "right") - 1
        left = (i - self.ranks[word]).astype(np.int16)
        parts = self.high[word].view(np.uint8).reshape(-1, 8)
        ones = np.cumsum(_ONES[parts], axis=1, dtype=np.int16)
        k = (ones <= left[:, None]).sum(1)
        row = np.arange(len(i))
        left = left - np.where(k > 0, ones[row, k - 1], 0).astype(np.int16)
        place = word * 64 + k * 8 + _SELECT[parts[row, k], left]
        out = (place - i).astype(np.uint64) << np.uint64(self.low_bits)
        return out | self._low(i) if self.low_bits else out

    def values(self) -> np.ndarray:
        """All numbers, decoded at once."""
        flags = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        i = np.arange(self.n)
        out = (np.flatnonzero(flags)[: self.n] - i).astype(np.uint64) << np.uint64(self.low_bits)
        return out | self._low(i) if self.low_bits else out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        over = shift > np.uint64(64 - self.low_bits)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.low_bits) - 1)

    def successor(self, q: np.ndarray) -> np.ndarray:
        """The place of the first number that is at least q, for each q; n where there is none. For many q all numbers are decoded once."""
        if 16 * len(q) > self.n:
            return np.searchsorted(self.values(), q)
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.n, np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self.get(middle) < q[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        return low


def search(keys: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The place of q in keys[low:high], each range ascending, or -1: a successor search within each range."""
    low, high, end = low.copy(), high.copy(), high
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        less = keys[middle] < q[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
        live = live[low[live] < high[live]]
    found = low < end
    found[found] = keys[low[found]] == q[found]
    return np.where(found, low, -1)


#: Probabilities are stored as steps of log10: STEPS of them a decade, in 16 bits; NONE marks what the trie has not.
STEPS = 256
NONE = np.uint16(0xFFFF)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 0xFFFE).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    """0 for NONE."""
    return np.where(code == NONE, 0.0, np.power(10.0, code.astype(np.float64) / -STEPS))


@dataclass
class Trie:
    """The levels: words (of 64 bits) with their counts; per word its pairs; per pair its triples.

    pair_p is the share of a pair in its context, rest the mass that the pair as a context leaves to shorter ones, triple_p the share of a triple.
    """

    words: EliasFano
    counts: np.ndarray
    pair_starts: EliasFano
    pairs: np.ndarray
    pair_p: np.ndarray
    rest: np.ndarray
    triple_starts: EliasFano
    triples: np.ndarray
    triple_p: np.ndarray

    ARRAYS = ("counts", "pairs", "pair_p", "rest", "triples", "triple_p")
    SEQUENCES = ("words", "pair_starts", "triple_starts")

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        place = self.words.successor(hashes)
        hit = place < self.words.n
        hit[hit] = self.words.get(place[hit]) == hashes[hit]
        return np.where(hit, place, -1)

    def _below(self, starts: EliasFano, keys: np.ndarray, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(node), -1, np.int64)
        known = np.flatnonzero(node >= 0)
        if len(known):
            nodes = node[known]
            if 4 * len(known) > starts.n:
                begins = starts.values().astype(np.int64)
                low, high = begins[nodes], begins[nodes + 1]
            else:
                low, high = starts.get(nodes).astype(np.int64), starts.get(nodes + 1).astype(np.int64)
            out[known] = search(keys, low, high, word[known])
        return out

    def find_pairs(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._below(self.pair_starts, self.pairs, node, word)

    def find_triples(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._below(self.triple_starts, self.triples, node, word)

    def to_bytes(self) -> bytes:
        parts: list[tuple[str, np.ndarray]] = [(k, getattr(self, k)) for k in self.ARRAYS]
        sizes = {}
        for k in self.SEQUENCES:
            s = getattr(self, k)
            sizes[k] = (s.n, s.low_bits)
            parts += [(f"{k}.{x}", getattr(s, x)) for x in ("low", "high", "ranks")]
        at, table = 0, {}
        for k, a in parts:
            table[k] = (str(a.dtype), len(a), at)
            at += -(-a.nbytes // 8) * 8
        head = json.dumps({"arrays": table, "sequences": sizes}).encode()
        head += b" " * (-len(head) % 8)
        body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for _, a in parts)
        return np.array([len(head)], "<u8").tobytes() + head + body

    @staticmethod
    def of(data: np.ndarray) -> "Trie":
        """A trie over bytes, which may be a memory-mapped file; nothing is copied."""
        n = int(data[:8].view("<u8")[0])
        head = json.loads(data[8 : 8 + n].tobytes())

        def array(k: str) -> np.ndarray:
            kind, size, at = head["arrays"][k]
            at += 8 + n
            return data[at : at + size * np.dtype(kind).itemsize].view(kind)

        sequences = {k: EliasFano(*head["sequences"][k], *(array(f"{k}.{x}") for x in ("low", "high", "ranks"))) for k in Trie.SEQUENCES}
        return Trie(**sequences, **{k: array(k) for k in Trie.ARRAYS})

    @staticmethod
    def mapped(path: str) -> "Trie":
        return Trie.of(np.memmap(path, np.uint8, "r"))


def starts_of(node: np.ndarray, nodes: int) -> EliasFano:
    """Where each of some nodes' successors begin, and the end, for successors sorted by node."""
    return EliasFano.of(np.searchsorted(node, np.arange(nodes + 1)), max(1, len(node) + 1))
