"""Table functions for SQL: passages, hrefs and visits. They take a row at a time, so that no partition is held in memory."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta
from html.entities import name2codepoint

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from .web import HIDDEN, HREF, REFERENCE


@dataclass
class Taken(AnalyzeResult):
    """The columns of a table that a function gives back as they are."""

    rest: tuple[str, ...] = ()


def _apart(rows: AnalyzeArgument, column: AnalyzeArgument, piece: str) -> Taken:
    """The table's columns but for one, pos and the pieces of that one."""
    fields = rows.dataType.fields
    if column.value not in rows.dataType.names:
        raise ValueError(f"the table has no column {column.value}")
    rest = [f for f in fields if f.name != column.value]
    if {f.name for f in rest} & {"pos", piece}:
        raise ValueError(f"the table has a column pos or {piece}, which the function adds")
    return Taken(schema=T.StructType([*rest, T.StructField("pos", T.LongType()), T.StructField(piece, T.StringType())]), rest=tuple(f.name for f in rest))


class Passages:
    """passages(table(t), 'column'): t without the column, and pos and passage for each of its lines that is not empty; pos counts empty ones. Null has none."""

    def __init__(self, taken: Taken):
        self.rest = taken.rest

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> Taken:
        return _apart(rows, column, "passage")

    def eval(self, rows: Row, column: str) -> Iterator[tuple]:
        kept = [rows[c] for c in self.rest]
        for pos, passage in enumerate((rows[column] or "").split("\n")):
            if passage:
                yield (*kept, pos, passage)


def _character(found: re.Match) -> str:
    name = found[0][1:-1]
    if not name.startswith("#"):
        return chr(name2codepoint[name]) if name in name2codepoint else found[0]
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 1 <= code <= 0xD7FF or 0xE000 <= code <= 0x10FFFF else "�"


class Hrefs:
    """hrefs(table(t), 'column'): t without the column of HTML, and pos and href for each link, with its character references replaced. Null has none."""

    def __init__(self, taken: Taken):
        self.rest = taken.rest

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> Taken:
        return _apart(rows, column, "href")

    def eval(self, rows: Row, column: str) -> Iterator[tuple]:
        kept = [rows[c] for c in self.rest]
        seen = re.sub(HIDDEN, " ", rows[column] or "", flags=re.ASCII)
        for pos, found in enumerate(re.finditer(HREF, seen, flags=re.ASCII)):
            href = re.sub(r"""^["']|["']$""", "", found[1])
            yield (*kept, pos, re.sub(REFERENCE, _character, href).replace(" ", " "))


class Visits:
    """visits(table(t) partition by key order by (time), 'key', 'time', minutes): key, first_at, last_at and n of each run of rows of a key with less than minutes from one to the next.

    It holds one visit at a time, so a key may have any number of rows. Rows without a time are left out; rows without a key are of one key.
    """

    def __init__(self) -> None:
        self.open: list | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for name in (key.value, at.value):
            if name not in kinds:
                raise ValueError(f"the table has no column {name}")
        time = kinds[at.value]
        return AnalyzeResult(schema=T.StructType([T.StructField(key.value, kinds[key.value]), T.StructField("first_at", time), T.StructField("last_at", time), T.StructField("n", T.LongType())]))

    def eval(self, rows: Row, key: str, at: str, minutes: int) -> Iterator[tuple]:
        now = rows[at]
        if now is None:
            return
        if self.open and now - self.open[2] < timedelta(minutes=minutes):
            self.open[2:] = [now, self.open[3] + 1]
            return
        if self.open:
            yield tuple(self.open)
        self.open = [rows[key], now, now, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield tuple(self.open)


FUNCTIONS = {"passages": Passages, "hrefs": Hrefs, "visits": Visits}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
