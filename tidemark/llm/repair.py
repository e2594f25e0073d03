"""Repair of the structure of conversations at the least cost, by layers of cost.

Roles have to follow the grammar (s?(ua)+)? in their initials. Its states are START (nothing yet), SYSTEM, USER and ANSWER; START and ANSWER accept. Edits of a
row: Keep (0), Rerole to user or assistant (3), Delete (4, a must for blank rows and repeats), and Insert of an empty user or assistant row anywhere (3);
a truncated row that stays costs 3 more.

Layers, in the manner of Wu and Manber: for each cost from 0 on, and each turn, a set of bits says from which states the rest can be made right at exactly this cost. Layer c
follows from layers c - 3, c - 4 and so on by tables over sets of states, and within itself by kept rows. The first layer that has START at the first turn
is the cost. The trace follows the bits from there and takes the first letter of D, I, K, R that stays in a set; each letter leads to one state only, so what it
writes is the least audit.

Conversations of any length: rows are numbered by ranges over all tasks and cut into chunks of ``CHUNK``. Layers of a chunk for each state behind it give a table of 4 x 4
costs. Going back over a conversation's chunks with these tables gives what each state behind each chunk costs; with that every chunk is traced by itself, from each
state before it. Repeats are found by the least number of equal rows, without gathering these. Only the last pass goes over a conversation in one task, in order:
a digest over its text can't be made in parts. It is sorted on disk, and holds an audit letter a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import shuffles, stored, table

CHUNK = 64
REROLE, INSERT, DELETE, LATE = 3, 3, 4, 3
START, SYSTEM, USER, ANSWER = range(4)
#: What it costs to come to an end from each state behind the last row.
ENDS = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
#: Where each initial leads from each state; -1: nowhere. An insert or another role leads to NEXT.
STEP = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ANSWER, -1)}
NEXT = (USER, USER, ANSWER, USER)
INITIALS = "sua"
PAD = 4
#: Bits of a row's code beside its initial: it has to go, it is truncated.
GONE, CUT = 8, 16
LETTERS = "DIKR"

NO_BLANK = r"[^\x20\x09-\x0D]"
UNFINISHED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


def _before(step: tuple[int, ...]) -> np.ndarray:
    """For each set of states those from which step leads into it."""
    return np.array([sum(1 << s for s, to in enumerate(step) if to >= 0 and found >> to & 1) for found in range(16)], np.uint8)


KEPT = np.stack([*(_before(STEP[x]) for x in INITIALS), np.zeros(16, np.uint8)])
MOVED = _before(NEXT)
TO = np.array([*(STEP[x] for x in INITIALS), (-1,) * 4])


def layers(codes: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Sets of states by cost (up to most), turn and chunk. codes: rows of each chunk, PAD before shorter ones; ends: costs of each state behind it."""
    b, n = codes.shape
    initial, gone, cut = codes & 7, (codes & GONE) > 0, (codes & CUT) > 0
    pad = (initial == PAD).T
    own = np.minimum(initial, 3).T
    stays, stays_cut, role, role_cut = ((~gone & ~cut).T & ~pad, (~gone & cut).T & ~pad, (~gone & ~cut).T & ~pad, (~gone & cut).T & ~pad)
    out = np.zeros((most + 1, n + 1, b), np.uint8)
    none = np.zeros((n + 1, b), np.uint8)
    at = lambda c: out[c] if c >= 0 else none
    inside, plain = ~pad, [bool(x) for x in (stays | pad).any(1)]
    for c in range(most + 1):
        now = out[c]
        now[n] = ((ends == c) << np.arange(4)).sum(1).astype(np.uint8)
        rest = np.where(inside, at(c - DELETE)[1:] | MOVED[at(c - INSERT)[:-1]], 0)
        rest |= np.where(role, MOVED[at(c - REROLE)[1:]], 0) | np.where(role_cut, MOVED[at(c - REROLE - LATE)[1:]], 0)
        rest |= np.where(stays_cut, KEPT[own, at(c - LATE)[1:]], 0)
        for i in range(n - 1, -1, -1):
            now[i] = rest[i]
            if plain[i]:
                now[i] |= np.where(pad[i], now[i + 1], np.where(stays[i], KEPT[own[i], now[i + 1]], 0))
    return out


def first_layers(found: np.ndarray) -> np.ndarray:
    """The least cost from each state before the first turn, for each chunk; NEVER where there is none."""
    has = (found[:, 0, :, None] >> np.arange(4)) & 1
    return np.where(has.any(0), has.argmax(0), NEVER)


def traces(codes: np.ndarray, found: np.ndarray, entry: int) -> tuple[list[str], np.ndarray]:
    """The least audit of each chunk from state entry before it at its least cost, and the state behind it."""
    b, n = codes.shape
    each = np.arange(b)
    cost, turn, state = first_layers(found)[:, entry], np.zeros(b, int), np.full(b, entry)
    written: list[np.ndarray] = []
    while (active := (turn < n) & (cost < NEVER)).any():
        code = codes[each, np.minimum(turn, n - 1)].astype(int)
        pad, gone, late = (code & 7) == PAD, (code & GONE) > 0, np.where(code & CUT, LATE, 0)
        has = lambda c, i, s: (c >= 0) & (s >= 0) & ((found[np.maximum(c, 0), np.minimum(i, n), each] >> np.maximum(s, 0)) & 1 > 0)  # noqa: B023, E731
        to, other = TO[np.minimum(code & 7, 3), state], np.array(NEXT)[state]
        can = np.stack([has(cost - DELETE, turn + 1, state), has(cost - INSERT, turn, other), ~gone & has(cost - late, turn + 1, to), ~gone & has(cost - REROLE - late, turn + 1, other)])
        letter = np.where(pad, -1, can.argmax(0))
        letter = np.where(active, letter, -2)
        spent = np.select([letter == 0, letter == 1, letter == 2, letter == 3], [DELETE, INSERT, late, REROLE + late], 0)
        state = np.select([letter == 2, (letter == 1) | (letter == 3)], [to, other], state)
        cost, turn = cost - spent, turn + ((letter == -1) | (letter == 0) | (letter >= 2))
        written.append(letter)
    letters = np.stack(written, 1) if written else np.zeros((b, 0), int)
    return ["".join(LETTERS[x] for x in row if x >= 0) for row in letters], state


def by_size(codes: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and codes of chunks of about the same length, some hundred at a time for long ones."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    start = 0
    while start < len(order):
        most, stop = 2 * max(4, len(codes[order[start]])), start
        while stop < len(order) and len(codes[order[stop]]) <= most and (stop - start) * most < 1 << 14:
            stop += 1
        places = order[start:stop]
        width = len(codes[places[-1]])
        block = np.full((len(places), width), PAD, np.uint8)
        for row, i in enumerate(places):
            if codes[i]:
                block[row, width - len(codes[i]) :] = np.frombuffer(codes[i], np.uint8)
        yield places, block
        start = stop


def tables_of(codes: list[bytes]) -> list[list[int]]:
    """For each chunk the costs from each state before it to each state behind it, 16 numbers."""
    out: list = [None] * len(codes)
    for places, block in by_size(codes):
        cost = np.stack([first_layers(layers(block, np.where(np.arange(4) == to, 0, NEVER)[None].repeat(len(block), 0), DELETE * block.shape[1] + 2 * INSERT)) for to in range(4)], 2)
        for i, row in zip(places, cost.reshape(len(places), 16).tolist()):
            out[i] = row
    return out


def traced(codes: list[bytes], ends: list[list[int]]) -> tuple[list[list[str]], list[list[int]]]:
    """For each chunk the audits from each state before it, and the states behind it."""
    audits, states = [[""] * 4 for _ in codes], [[0] * 4 for _ in codes]
    for places, block in by_size(codes):
        behind = np.array([ends[i] for i in places])
        behind = np.minimum(behind - behind.min(1, keepdims=True), NEVER)
        reach = DELETE * block.shape[1] + 2 * INSERT + int(np.where(behind < NEVER // 2, behind, 0).max())
        found = layers(block, behind, reach)
        for entry in range(4):
            texts, after = traces(block, found, entry)
            for i, text, state in zip(places, texts, after.tolist()):
                audits[i][entry], states[i][entry] = text, state
    return audits, states


def _order(role: Column, text: Column) -> list[Column]:
    """Rows of a turn in order: by the beginnings of role and text, then by a digest; rows that are still alike are equal."""
    return [F.left(role, F.lit(64)).alias("o1"), F.left(text, F.lit(64)).alias("o2"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest")]


def _plain(turns: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row for each chunk: conv_id, number (of its first row), codes, its table and what its rows count up to.

    Rows (conv_id, turn, role, text) are put in order by ranges of conversation and turn; a conversation may be in many tasks.
    """
    spark = rows.sparkSession
    tasks = shuffles(spark)
    order = ["conv_id", "turn", "o1", "o2", "digest"]
    text = F.col("text")
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    keyed = rows.select("conv_id", "turn", *_order(F.col("role"), text), initial.alias("initial"), F.regexp_like(text, F.lit(NO_BLANK)).alias("filled"), F.regexp_like(text, F.lit(UNFINISHED)).alias("cut"))
    keyed = keyed.withColumn("tie", F.monotonically_increasing_id())
    sorted_rows = keyed.repartitionByRange(tasks, *order, "tie").sortWithinPartitions(*order, "tie").withColumn("number", F.monotonically_increasing_id())
    numbered = stored(sorted_rows.select("conv_id", "turn", "digest", "initial", "filled", "cut", "number"), "turns")
    firsts = numbered.groupBy("conv_id", "digest").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("new"))
    fault = F.when(~F.col("filled"), 1).when(F.col("new").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    marked = numbered.join(firsts, "number", "left").select("number", "conv_id", "turn", "initial", fault.alias("fault"))
    marked = marked.repartitionByRange(tasks, "number").sortWithinPartitions("number")
    counts = ("number", "n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail")
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(", ".join(f"{c} long" for c in counts) + ", codes binary, costs array<long>").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            if not open_rows:
                return
            conv, initials, faults = open_rows[0][1], [r[3] for r in open_rows], [r[4] for r in open_rows]
            turns = [r[2] for r in open_rows if r[2] is not None]
            illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))
            codes = bytes(i | (GONE if f in (1, 2) else CUT if f == 3 else 0) for i, f in zip(initials, faults))
            done.append((conv, open_rows[0][0], len(open_rows), faults.count(1), faults.count(2), faults.count(3), illegal, len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, initials[0], initials[-1], codes))
            open_rows.clear()

        def batch() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*done)] or [[] for _ in range(13)]
            conv = pa.array(columns[0], kind)
            arrays = [conv, *(pa.array(x, pa.int64()) for x in columns[1:12]), pa.array(columns[12], pa.binary()), pa.array(tables_of(columns[12]), pa.list_(pa.int64()))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *counts, "codes", "costs"])

        kind = None
        for b in batches:
            kind = b.schema.field("conv_id").type
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if open_rows and (len(open_rows) == size or open_rows[0][1] != r[1]):
                    close()
                open_rows.append(r)
            if done:
                yield batch()
        close()
        if done:
            yield batch()

    return stored(marked.mapInArrow(run, schema), "chunks")


def backed(chunks: DataFrame) -> DataFrame:
    """chunks with cost (from START before it) and the audits and states behind it for each state before it."""
    names = chunks.columns
    c, costs_at = names.index("conv_id"), names.index("costs")
    with_ends = T.StructType([*chunks.schema.fields, *T.StructType.fromDDL("ends array<long>, cost long").fields])

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ends = object(), list(ENDS)
        for b in batches:
            out, cost = [], []
            for key, t in zip(b.column(c).to_pylist(), b.column(costs_at).to_pylist()):
                if key != conv:
                    conv, ends = key, list(ENDS)
                out.append(ends)
                ends = [min(t[4 * s + to] + ends[to] for to in range(4)) for s in range(4)]
                cost.append(ends[START])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64())), pa.array(cost, pa.int64())], [*names, "ends", "cost"])

    kept = [n for n in names if n not in ("codes", "costs")]
    schema = T.StructType([*(chunks.schema[n] for n in kept), *T.StructType.fromDDL("cost long, audits array<string>, states array<long>").fields])

    def trace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                audits, states = traced(b.column("codes").to_pylist(), b.column("ends").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), b.column("cost"), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64()))], [*kept, "cost", "audits", "states"])

    ended = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("number").desc()).mapInArrow(back, with_ends)
    return ended.repartition(shuffles(chunks.sparkSession), "conv_id", "number").mapInArrow(trace, schema)


class Walk:
    """One conversation: its chunks in order, then its rows in order."""

    def __init__(self, conv):
        self.conv, self.state, self.pieces = conv, START, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.tail = self.cost = None
        self.audit, self.at, self.now, self.digest, self.any = "", 0, START, hashlib.sha256(), False

    def chunk(self, x: dict) -> None:
        if self.cost is None:
            self.cost = x["cost"]
        for name in self.counts:
            self.counts[name] += x[name]
        if self.tail is not None and (self.tail, x["head"]) not in ((0, 1), (1, 2), (2, 1)):
            self.counts["illegal"] += 1
        self.tail = x["tail"]
        if x["low"] is not None:
            self.counts["turns"] -= self.high == x["low"]
            self.low, self.high = x["low"] if self.low is None else self.low, x["high"]
        self.pieces.append(x["audits"][self.state])
        self.state = x["states"][self.state]

    def ready(self) -> None:
        if self.pieces or not self.audit:
            self.audit = "".join(self.pieces) + {SYSTEM: "II", USER: "I"}.get(self.state, "")
            self.pieces = []

    def emit(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        return role, text

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.now = NEXT[self.now]
            yield self.emit("user" if self.now == USER else "assistant", "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        self.ready()
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.now = STEP[role[0]][self.now]
            yield self.emit(role, text)
        elif letter == "R":
            self.now = NEXT[self.now]
            yield self.emit("user" if self.now == USER else "assistant", text)

    def end(self) -> tuple:
        gaps = self.high - self.low + 1 - self.counts["turns"] if self.low is not None else 0
        c = self.counts
        return self.conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost or 0, self.audit, self.digest.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _walked(turns: DataFrame, ids: DataFrame, whole: bool, size: int) -> DataFrame:
    rows = _plain(turns)
    chunks = backed(chunked(rows, size))
    fields = [n for n in chunks.columns if n != "conv_id"]
    lines = rows.select("conv_id", "turn", *_order(F.col("role"), F.col("text")), "role", "text")
    empty = lambda df, names: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    keys, info = ["turn", "o1", "o2", "digest", "role", "text"], F.struct(*fields).alias("info")
    boxed = chunks.select("conv_id", info)
    marker = ids.select("conv_id", F.lit(0).alias("kind"), *empty(lines, keys), *empty(boxed, ["info"]), F.lit(0).cast("long").alias("number"))
    heads = boxed.select("conv_id", F.lit(1).alias("kind"), *empty(lines, keys), "info", F.col("info.number").alias("number"))
    texts = lines.select("conv_id", F.lit(2).alias("kind"), *keys, *empty(boxed, ["info"]), F.lit(0).cast("long").alias("number"))
    union = marker.unionByName(heads).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "number", "turn", "o1", "o2", "digest")
    new = T.StructType.fromDDL("position long, role string, text string" if whole else REPORT)
    schema = T.StructType([turns.schema["conv_id"], *new.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, place, kind_of = None, 0, None
        out: list[tuple] = []

        def add(found: Iterable[tuple[str, str]]) -> None:
            nonlocal place
            for pair in found:
                if whole:
                    out.append((walk.conv, place, *pair))
                place += 1

        def finish() -> None:
            if walk is not None:
                walk.ready()
                add(walk.inserts())
                if not whole:
                    out.append(walk.end())

        def batch() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*out)] or [[] for _ in schema.fields]
            kinds = [kind_of, *(pa.string() if f.dataType == T.StringType() else pa.int64() for f in new.fields)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], schema.names)

        for b in batches:
            kind_of = b.schema.field("conv_id").type
            for conv, kind, role, text, info in zip(*(b.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text", "info"))):
                if kind == 0:
                    finish()
                    walk, place = Walk(conv), 0
                elif kind == 1:
                    walk.chunk(info)
                else:
                    add(walk.row(role, text))
            if out:
                yield batch()
        finish()
        if out:
            yield batch()

    return union.mapInArrow(run, schema)


def reports(turns: DataFrame, ids: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, a row for each conversation of ids (default: of turns).

    turns: conv_id, turn, role, text; other columns play no part. Null roles and texts are one space, so such texts are blank; a null conv_id is a conversation. Rows go by
    turn, nulls first, those of one turn by role and text. A conversation of ids without rows has zeros, no audit and the digest of nothing. An empty table gives no rows.
    """
    ids = turns if ids is None else ids
    return _walked(turns, ids.select("conv_id").distinct(), False, size)


def repaired(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, position (from 0), role and text of the repaired conversations; what is left empty has no rows."""
    return _walked(turns, turns.select("conv_id").distinct(), True, size)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one space, damaged by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = _plain(turns).withColumn("hit", F.crc32(key) % 20).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a rule and repaired."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return reports(damaged(turns), turns)


_SPACE = r"[\x20\x09-\x0D]"
_CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda x: ascii(x)::ubigint)), lambda c, b: xor(c >> 8, crc[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint)"
_PAY = lambda cost, letter, state: f"(case when {state} is not null then printf('%09d', substr({state}, 1, 9)::int + {cost}) || substr({state}, 10) || '{letter}' end)"


def _sql() -> str:
    """The cheapest audits to each state, row by row, as text of nine digits and letters."""
    free, late = "not gone", f"case when cut then {LATE} else 0 end"
    keep = {0: "null", 1: f"case when {free} and i = 's' then {_PAY(late, 'K', 's0')} end", 2: " ".join(["least(" + ", ".join(f"case when {free} and i = 'u' then {_PAY(late, 'K', s)} end" for s in ("s0", "s1", "s3")) + ")"]), 3: f"case when {free} and i = 'a' then {_PAY(late, 'K', 's2')} end"}
    role = {2: "least(" + ", ".join(f"case when {free} then {_PAY(f'{REROLE} + {late}', 'R', s)} end" for s in ("s0", "s1", "s3")) + ")", 3: f"case when {free} then {_PAY(f'{REROLE} + {late}', 'R', 's2')} end"}
    after = [f"least({_PAY(DELETE, 'D', f's{n}')}, {keep[n]}, {role.get(n, 'null')})" for n in range(4)]
    two = f"least(s2, {_PAY(INSERT, 'I', 's0')}, {_PAY(INSERT, 'I', 's1')}, {_PAY(INSERT, 'I', 's3')})"
    three = f"least(s3, {_PAY(INSERT, 'I', 's2')}, {_PAY(2 * INSERT, 'II', 's0')}, {_PAY(2 * INSERT, 'II', 's1')})"
    closed = lambda rows: f"(select * exclude (s2, s3), {two} as s2, {three} as s3 from {rows})"
    return rf"""
with recursive t as (select list((list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) order by n) as crc from range(256) as r(n)),
r0 as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
r1 as (select conv_id, turn, role, text, {_CRC} % 20 as hit from r0, t),
r2 as (select conv_id, turn, case hit when 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case hit when 3 then [0, 1] else [0] end) as copy from r1 where hit <> 0),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n from r2),
r3 as (select *, row_number() over (partition by conv_id, role, text order by n) > 1 as seen, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, regexp_matches(text, '[^\x20\x09-\x0D.!?]{_SPACE}*\z') as raw_cut from r),
r4 as materialized (select *, blank or seen as gone, not blank and not seen and raw_cut as cut, role[1] as i from r3),
ids as (select distinct conv_id from conversations),
p as (
  select conv_id, 0 as n, s0, s1, s2, s3 from {closed("(select conv_id, printf('%09d', 0) as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from ids)")}
  union all
  select conv_id, n, s0, s1, s2, s3 from {closed(f"(select p.conv_id, r4.n, {', '.join(f'{x} as s{j}' for j, x in enumerate(after))} from p join r4 on r4.conv_id is not distinct from p.conv_id and r4.n = p.n + 1)")}
),
best as (select conv_id, least(s0, s3) as b from p qualify row_number() over (partition by conv_id order by n desc) = 1),
a as (select conv_id, substr(b, 1, 9)::bigint as cost, substr(b, 10) as audit from best),
l as (select conv_id, audit, unnest(range(1, length(audit) + 1)) as q from a),
m as (select conv_id, q, audit[q] as e, sum((audit[q] <> 'I')::int) over (partition by conv_id order by q) as n, sum((audit[q] <> 'D')::int) over (partition by conv_id order by q) as o from l),
w as (select m.conv_id, q, e, o, r4.role, r4.text, max((e = 'K' and o = 1 and r4.i = 's')::int) over (partition by m.conv_id) as s from m left join r4 on r4.conv_id is not distinct from m.conv_id and r4.n = m.n),
h as (select conv_id, string_agg(case when e = 'K' then role when (o - s) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by q) as whole from w where e <> 'D' group by conv_id),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank, sum((seen and not blank)::int) as duplicate, sum(cut::int) as truncated from r4 group by conv_id),
f as (select conv_id, sum((x not in ('su', 'ua', 'au'))::int) as illegal from (select conv_id, lag(i) over (partition by conv_id order by n) || i as x from r4) group by conv_id)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, cost, audit, sha256(coalesce(whole, '')) as repaired_sha256
from ids left join a on ids.conv_id is not distinct from a.conv_id left join g on ids.conv_id is not distinct from g.conv_id left join f on ids.conv_id is not distinct from f.conv_id left join h on ids.conv_id is not distinct from h.conv_id
"""


OP11_SQL = _sql()
