"""Benchmark decontamination, in DataFrame operations alone.

Texts and items are words (runs of letters, marks and digits, lower case) and their shingles of ``SHINGLE`` words, or the whole
sequence where an item is shorter. The similarity of a window and an item is the weight of the shingles that both have over that of the
shingles that either has; a shingle weighs as many as its words have characters.

1. Windows: every window of a text that is as long as an item, in words, and shares a shingle with it is a candidate for it, as the similarity of all others is
   0. A shared shingle at word p of a text is in the windows that start from p - length + k to p. Shingles of texts meet those of items in a join on their hashes.
2. The weight of the shared shingles in a window bounds what both have in common from above. Each one adds its weight where its windows begin and takes
   it off behind them, so running sums give the bound of all windows at once; those where it is below ``SIMILARITY`` times the item's weight can be no leak.
3. The others are cut out of the text and compared with their items by their exact similarity; those of at least ``SIMILARITY`` are leaks. No print, radius or count
   stands before that, so none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import stored, table

SHINGLE = 5
SIMILARITY = 0.75
#: Shingles of items (16 bytes each) that are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Parts that the windows of an item are dealt to where items are joined by a shuffle.
DEALT = 16
#: How letters, marks and digits are told from the rest.
BREAKS = r"[^\p{L}\p{M}\p{N}]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def weighted(words: Column, k: Column) -> Column:
    """The distinct shingles of k words of a list that has k at least: structs of hash h and weight w."""
    starts = F.sequence(F.lit(1), F.size(words) - k + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.struct(F.xxhash64(F.array_join(F.slice(words, i, k), " ")).alias("h"), (F.length(F.array_join(F.slice(words, i, k), ""))).cast("long").alias("w"))))


def total(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, s: a + s["w"])


def indexed(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Items with words, length, k (words of a shingle) and shingles; items without a word are left out."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), word_list(F.col(f"`{text}`")).alias("item_words"))
    items = stored(items.where(F.size("item_words") > 0), "item-words").withColumn("length", F.size("item_words")).withColumn("k", F.least(F.col("length"), F.lit(SHINGLE)))
    return items.withColumn("item_shingles", weighted(F.col("item_words"), F.col("k")))


def row_key(id_column: Column, text: Column) -> Column:
    """A key of a row by its content; rows that repeat share it."""
    return F.xxhash64(id_column.cast("string"), F.coalesce(text, F.lit("")))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_key, doc_id, item_id, similarity, position (of the best window, in words from 0) and window_words of all leaks.

    Null and empty texts and items leak nothing. Rows that repeat in id and text give one row; items that repeat in text each give theirs, and those that repeat
    in id and text one. Other columns of either table play no part. An empty table gives an empty table.
    """
    # tables are written between steps, so that no later filter makes Spark compute word lists or shingles again for each use
    items = stored(indexed(benchmark, item_id, item_text).dropDuplicates(["item_id", "item_words"]).withColumn("item_key", F.xxhash64(F.col("item_id").cast("string"), "item_words")), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # 1 to SHINGLE
    hashed = items.select("item_key", "length", "k", "item_words", total(F.col("item_shingles")).alias("total"), _hashes(F.col("item_words")).alias("hashes"))
    gram_of = lambda hashes, at, k: F.xxhash64(*(F.get(hashes, at + j) for j in range(k)))
    plain = docs.select(row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("doc_key"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    listed = plain.select("doc_key", _hashes(word_list(F.col("text"))).alias("hashes"))

    anchors = None
    for k in sizes:
        n = F.size("hashes") - (k - 1)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        grams = lambda: F.transform(starts, lambda i: gram_of(F.col("hashes"), i, k))  # noqa: B023, E731
        weights = F.transform(starts, lambda i: F.length(F.array_join(F.slice("item_words", i + 1, k), "")).cast("long"))  # noqa: B023
        at_item = hashed.where(F.col("k") == k).select("item_key", "length", "total", F.explode(F.arrays_zip(grams().alias("gram"), weights.alias("weight"))).alias("x")).select("item_key", "length", "total", "x.*").distinct()
        at_text = listed.select("doc_key", F.size("hashes").alias("n"), F.posexplode(grams()).alias("place", "gram"))
        few = at_item.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        last = F.greatest(F.col("n") - F.col("length"), F.lit(0))  # a text shorter than the item is one window
        first = F.least(F.greatest(F.col("place") - F.col("length") + k, F.lit(0)), last)
        found = at_text.join(F.broadcast(at_item) if few else at_item, "gram").select("doc_key", "item_key", "length", "total", "weight", first.alias("first"), F.least("place", last).alias("last"))
        anchors = found if anchors is None else anchors.unionByName(found)
    if anchors is None:
        anchors = listed.select("doc_key", *(F.lit(0).cast(t).alias(c) for c, t in (("item_key", "long"), ("length", "int"), ("total", "long"), ("weight", "long"), ("first", "int"), ("last", "int")))).where(F.lit(False))
    turns = anchors.select("doc_key", "item_key", "length", "total", F.explode(F.array(F.struct(F.col("first").alias("start"), F.col("weight").alias("more")), F.struct((F.col("last") + 1).alias("start"), (-F.col("weight")).alias("more")))).alias("x"))
    turns = turns.groupBy("doc_key", "item_key", "length", "total", "x.start").agg(F.sum("x.more").alias("more"))
    by = Window.partitionBy("doc_key", "item_key").orderBy("start")
    spans = turns.withColumn("bound", F.sum("more").over(by)).withColumn("until", F.lead("start").over(by)).where(F.col("bound") >= SIMILARITY * F.col("total"))
    windows = stored(spans.select("doc_key", "item_key", "length", F.explode(F.sequence("start", F.col("until") - 1)).alias("start")), "windows")

    # each text is split once for all of its windows: its words are a column of a table, else Spark would split it again for each window
    places = windows.groupBy("doc_key").agg(F.collect_set(F.struct("item_key", "length", "start")).alias("places"))
    whole = plain.join(places, "doc_key").dropDuplicates(["doc_key"]).select("doc_key", "doc_id", word_list(F.col("text")).alias("words"), "places")
    whole = stored(whole, "texts")
    cut = F.explode("places").alias("x")
    texts = whole.select("doc_key", "doc_id", "words", cut).select("doc_key", "doc_id", "x.*", F.expr("slice(words, x.start + 1, x.length)").alias("window"))
    k = F.least(F.col("length"), F.lit(SHINGLE))
    # of a text's windows of the same words the first is compared for all
    texts = texts.where(F.size("window") >= k).groupBy("doc_key", "doc_id", "item_key", "length", "window").agg(F.min("start").alias("start"))
    texts = stored(texts, "window-words")
    texts = stored(texts.withColumn("shingles", weighted(F.col("window"), k)).drop("window"), "window-shingles")

    right = items.select("item_key", "item_id", "item_shingles")
    if (items.agg(F.sum(F.size("item_shingles"))).first()[0] or 0) <= BROADCAST_ROWS:
        near = texts.join(F.broadcast(right), "item_key")
    else:  # an item may be in a large part of all texts
        part = F.pmod(F.xxhash64("doc_key", "start"), F.lit(DEALT)).cast("int")
        near = texts.withColumn("part", part).join(right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))), ["item_key", "part"])
    both, either = total(F.array_intersect("shingles", "item_shingles")), total(F.array_union("shingles", "item_shingles"))
    same = near.withColumn("similarity", both / either).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "length")).alias("best")
    out = same.groupBy("doc_key", "doc_id", "item_id").agg(best)
    return out.select("doc_key", "doc_id", "item_id", "best.similarity", (-F.col("best.before")).cast("long").alias("position"), F.col("best.length").cast("long").alias("window_words"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with all their columns."""
    keys = leaks(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), benchmark).select("doc_key").distinct()
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    keyed = plain.withColumn("doc_key", row_key(F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}")))
    return keyed.join(keys, "doc_key", "left_anti").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of all items of benchmark into all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark")).drop("doc_key")


OP3_SQL = r"""
with d as (select distinct doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w from documents),
docs as (select row_number() over () as r, doc_id, w from d),
i as (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w from benchmark),
items as (select row_number() over () as q, item_id, w, len(w) as n, least(len(w), 5) as k from i where len(w) > 0),
ks as (select distinct k from items),
dp as (select r, k, w, unnest(range(1, len(w) - k + 2)) as p from docs, ks where len(w) >= k),
dg as (select r, k, p, array_to_string(w[p : p + k - 1], ' ') as g from dp),
ip as (select q, k, n, w, unnest(range(1, len(w) - k + 2)) as p from items),
ig as (select q, k, n, p, array_to_string(w[p : p + k - 1], ' ') as g, length(array_to_string(w[p : p + k - 1], '')) as c from ip),
hit as (select r, q, dg.p - 1 as p, ig.n, dg.k, len(docs.w) as m from dg join ig on dg.g = ig.g and dg.k = ig.k join docs using (r)),
win as (select distinct r, q, unnest(range(least(greatest(p - n + k, 0), greatest(m - n, 0)), least(p, greatest(m - n, 0)) + 1)) as s from hit),
cut as (select r, q, doc_id, item_id, n, k, docs.w as w, s from win join docs using (r) join items using (q)),
wp as (select r, q, s, k, doc_id, item_id, n, w, unnest(range(s + 1, least(s + n, len(w)) - k + 2)) as p from cut),
wg as (select distinct r, q, s, doc_id, item_id, n, array_to_string(w[p : p + k - 1], ' ') as g, length(array_to_string(w[p : p + k - 1], '')) as c from wp),
iset as (select distinct q, g, c from ig),
itot as (select q, sum(c) as t from iset group by q),
wtot as (select r, q, s, doc_id, item_id, n, sum(c) as t from wg group by all),
both_ as (select r, q, s, sum(wg.c) as b from wg join iset using (q, g) group by r, q, s),
sim as (select doc_id, item_id, n, s, b / (wtot.t + itot.t - b)::double as x from both_ join wtot using (r, q, s) join itot using (q)),
best as (select doc_id, item_id, n, s, x, row_number() over (partition by doc_id, item_id order by x desc, s, n desc) as o from sim where x >= 0.75)
select doc_id, item_id, x as similarity, s::bigint as position, n::bigint as window_words from best where o = 1
"""
