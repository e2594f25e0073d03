"""Quality rules: a ledger of failure bits and measurements, and policies over the bits.

Every rule is evaluated once per text. ``ledger`` stores what was measured and one
long whose bit i says that rule i failed. A policy is a version name and a mask of
the rules that reject; applying it, or asking what the corpus would be without one
of its rules, reads the bits alone and never a text again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words
from .tables import stored, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper_words")

#: Characters that count as symbols. A fixed value.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """name, and a SQL condition over MEASURES that holds where the rule fails."""

    name: str
    fails: str


#: Bit i of a ledger belongs to rule i. Rules are only ever appended, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("upper_case", "100 * n_upper_words > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)

#: Versions of the policy: the rules that reject. Versions are never changed, only added.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": ("few_words", "repeated_windows", "symbols", "upper_case", "repeated_lines"),
}


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(at[x] for x in POLICIES[policy])


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {k: [] for k in MEASURES}
    for g in words.groups(column):
        n, data = g.n_docs, g.data
        spans = words.Spans(data)
        size = lambda flags: np.concatenate((np.zeros(1, np.int64), np.cumsum(flags)))
        chars = size((data & 0xC0) != 0x80)
        upper, lower = size((data >= 65) & (data <= 90)), size((data >= 97) & (data <= 122))
        found["n_words"].append(words.per_doc(None, g.doc, n))
        found["word_chars"].append(words.per_doc(chars[g.end] - chars[g.start], g.doc, n))
        shouted = (upper[g.end] > upper[g.start]) & (lower[g.end] == lower[g.start])
        found["n_upper_words"].append(words.per_doc(shouted, g.doc, n))
        symbols = size(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
        found["n_symbols"].append(symbols[g.bounds[1:]] - symbols[g.bounds[:-1]])

        # lines: the text between two line ends or ends of the text, if it has a word
        cut = np.union1d(np.flatnonzero(data == 10), g.bounds)
        start = np.where(data[np.minimum(cut[:-1], max(len(data) - 1, 0))] == 10, cut[:-1] + 1, cut[:-1]) if len(data) else cut[:0]
        end = cut[1:] if len(data) else cut[:0]
        letters = size(~words.SPACE[data])
        full = letters[end] > letters[np.minimum(start, end)]
        start, end = start[full], end[full]
        doc = np.searchsorted(g.bounds, start, "right") - 1
        line = words.chain(spans.hash(start, end), (end - start).astype(np.uint64), doc.astype(np.uint64))
        _, first = np.unique(line, return_index=True)
        n_lines = words.per_doc(None, doc, n)
        found["n_lines"].append(n_lines)
        found["n_dup_lines"].append(n_lines - words.per_doc(None, doc[first], n))

        h = spans.hash(g.start, g.end)
        at = words.runs(g.doc, 3)
        window = words.chain(h[at], h[at + 1], h[at + 2], g.doc[at].astype(np.uint64)) if len(at) else h[:0]
        _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[again + k] = True
        found["n_repeat_words"].append(words.per_doc(covered, g.doc, n))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES in place of the text.

    A null text counts as an empty one: all measures are 0. Columns of docs that bear the name
    of a measure are replaced by it. Rows that repeat stay; an empty table gives an empty table.
    Lines are compared as they stand, words without change of case.
    """
    keep = [c for c in docs.columns if c != text and c not in MEASURES]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _measure(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(m[k], pa.int64()) for k in MEASURES)], [*keep, *MEASURES])
        words.release()

    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`"))
    schema = reduce(lambda s, k: s.add(k, "long"), MEASURES, source.drop(text).schema)
    return source.mapInArrow(run, schema)


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)])


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs without text, with MEASURES and the long failed_rules; see measure for odd rows."""
    return measure(docs, text).withColumn("failed_rules", failures(rules))


def rejects(policy: str) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(mask(policy))) != 0


def ablation(ledger_df: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: how many rows it rejects, how many it alone rejects, and how many are kept without it.

    One pass of bitwise tests and sums over the ledger; a row per rule. Over an empty ledger all counts are 0.
    """
    m = mask(policy)
    bits = {r.name: 1 << i for i, r in enumerate(RULES) if m >> i & 1}
    failed = F.col("failed_rules").bitwiseAND(F.lit(m))
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    one = ledger_df.agg(
        *(F.struct(F.lit(name).alias("rule"), count(failed.bitwiseAND(F.lit(b)) != 0).alias("rejected"), count(failed == b).alias("alone"), count(failed.bitwiseAND(F.lit(m & ~b)) == 0).alias("kept_without")).alias(name) for name, b in bits.items())
    )
    return one.select(F.explode(F.array(*bits)).alias("x")).select(F.lit(policy).alias("policy"), "x.*")


def filtered(docs: DataFrame, policy: str = "full-1", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns. The text goes to the worker once and comes back beside its measures, so nothing is joined or shuffled."""
    names, n = docs.columns, len(docs.columns)
    at = names.index(text)
    plain = docs.toDF(*(f"c{i}" for i in range(n)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _measure(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m[k], pa.int64()) for k in MEASURES)], [*(f"c{i}" for i in range(n)), *MEASURES])
        words.release()

    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    measured = plain.mapInArrow(run, reduce(lambda s, k: s.add(k, "long"), MEASURES, StructType(list(plain.schema)))).withColumn("failed_rules", failures())
    return measured.where(~rejects(policy)).select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(names)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the base measures, the base verdict and the verdict of policy full-1."""
    found = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejects("base-1").alias("base_failed"), (~rejects("full-1")).alias("kept"), "n_lines", "n_upper_words", "failed_rules",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to all documents, from a ledger that is stored once and whose bits alone are read."""
    kept = stored(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "ledger")
    return reduce(DataFrame.unionAll, [ablation(kept, policy) for policy in POLICIES])


OP5_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
pos as (select r, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3),
win as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from pos),
rep as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from win where n > 1) group by r),
line as (select r, unnest(string_split(text, chr(10))) as l from docs),
dup as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
m as (select doc_id, len(w)::bigint as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]')))::bigint as n_upper_words
  from docs join words using (r) left join rep using (r) left join dup using (r)),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 100 * n_symbols > 10 * n_words then 4 else 0 end + case when 100 * n_upper_words > 30 * n_words then 8 else 0 end
    + case when 100 * n_dup_lines > 50 * n_lines then 16 else 0 end)::bigint as failed_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 as base_failed,
  failed_rules = 0 as kept, n_lines, n_upper_words, failed_rules from f
"""

_BITS = {r.name: 1 << i for i, r in enumerate(RULES)}
_COUNTS = "select '{policy}' as policy, '{rule}' as rule, count(*) filter (failed_rules & {bit} <> 0) as rejected, count(*) filter (failed_rules & {mask} = {bit}) as alone, count(*) filter (failed_rules & {others} = 0) as kept_without from ledger"
ABLATION_SQL = f"with ledger as ({OP5_SQL}) " + " union all ".join(
    _COUNTS.format(policy=policy, rule=rule, bit=_BITS[rule], mask=mask(policy), others=mask(policy) & ~_BITS[rule]) for policy, rules in POLICIES.items() for rule in rules
)
