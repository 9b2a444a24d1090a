"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

Words are `[^\\x20\\x09-\\x0D]+` of the lowered text; a shingle is `WORDS` words in a row (all words
of a shorter item) and weighs its number of characters. A window has as many words as the item it
is held against, or the whole text if that is shorter.

1. Every shingle of every text meets the items' shingles by a join on a 64-bit hash. A meeting at
   word p of the text and word j of the item proposes the window from p - j on, moved inside the
   text. A window without a common shingle has similarity 0. Where words were put in or left out, the best window may begin
   between two proposed ones, so all starts between two neighbours of an item's length or less are proposed too. The
   window that is returned is the best of those proposed; a start a few words off may be better by a little.
2. A window's and an item's fingerprint is a weighted 64-bit SimHash. `RADIUS` + 1 blocks of bits
   index it: two fingerprints within the radius agree in one block at least, so joining windows and
   items of one size by (block, value) finds all of them. The distance decides who stays.
3. Weighted Jaccard similarity of the two shingle sets, computed exactly, has to reach `LEAST`.

At similarity 0.8 a bit differs with a chance of 0.15, so 64 bits differ in 10 places, give or take
3; the radius is over four deviations beyond that, and equal passages have distance 0.

An items' table is broadcast only below `BROADCAST` rows of some 40 bytes, counted for each: the items' shingles by
place, and the items' fingerprints by block. Beyond, joins shuffle and adaptive execution splits frequent
shingles. Shingles of items join only the pairs that fingerprints leave, by item.

A null or empty text or item has no shingle and matches nothing. Rows with one doc_id are one document with several
texts, and the best window counts, of equal ones the first; so are rows with a null doc_id. `ident` may be a column of any
type. Texts of any length are read whole. Columns but the id and the text are not read. Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, words

WORDS, LEAST = 5, 0.8
BITS, RADIUS = 64, 23
#: Rows of a table of the items that may be broadcast.
BROADCAST = 400_000


def block_bounds(bits: int = BITS, blocks: int = RADIUS + 1) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block, as even as can be."""
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def shingle_array(w: str, k: Column) -> Column:
    """Distinct shingles (h, weight) of a word array of at least k words."""
    places = F.sequence(F.lit(1), F.size(w) - k + 1)
    return F.array_distinct(F.transform(places, lambda i: F.struct(F.xxhash64(F.array_join(F.slice(w, i, k), " ")).alias("h"), F.length(F.array_join(F.slice(w, i, k), "")).cast("long").alias("weight"))))


def weight_of(shingles: str) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + x["weight"])


def simhash(shingles: str) -> Column:
    """Bit b is set if the shingles with it outweigh the others, or weigh as much."""

    def bit(b: Column) -> Column:
        total = F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.getbit(x["h"], b) == 1, x["weight"]).otherwise(-x["weight"]))
        return F.when(total >= 0, F.expr("1L")).otherwise(F.expr("0L"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(b), b)))


def blocks(fingerprint: str) -> Column:
    """(block, value) of each block."""
    one = [F.struct(F.lit(k).alias("block"), F.call_function("shiftrightunsigned", F.col(fingerprint), F.lit(a)).bitwiseAND(F.lit((1 << n) - 1).cast("long")).alias("value")) for k, (a, n) in enumerate(block_bounds())]
    return F.array(*one)


def items_of(benchmark: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, size, k, shingles, weight, fingerprint of the items that have words."""
    df = benchmark.select(F.col(ident).alias("item_id"), words(F.lower(F.col(text))).alias("_w")).where(F.size("_w") > 0)
    df = df.withColumn("size", F.size("_w")).withColumn("k", F.least(F.size("_w"), F.lit(WORDS)))
    df = df.withColumn("shingles", shingle_array("_w", F.col("k")))
    return df.withColumn("weight", weight_of("shingles")).withColumn("fingerprint", simhash("shingles"))


def text_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(doc, n, p, k, h) of every shingle of every text; docs has words `_w`."""
    m = F.greatest(F.size("_w") - (k - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice("_w", F.lit(j + 1), m).alias(f"w{j}") for j in range(k)])
    rows = docs.where(m > 0).select("doc", F.size("_w").alias("n"), F.posexplode(runs).alias("p", "run"))
    return rows.select("doc", "n", "p", F.lit(k).alias("k"), F.xxhash64(F.concat_ws(" ", *[F.col("run")[f"w{j}"] for j in range(k)])).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row (doc_id, item_id, start, similarity) for each text and item that match."""
    items = staged(items_of(benchmark), "bench-items")
    item_words = benchmark.select("item_id", words(F.lower(F.col("text"))).alias("_w")).where(F.size("_w") > 0)
    anchors = items.select("item_id", "size", "k").join(item_words, "item_id")
    anchors = anchors.select("item_id", "size", "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.col("k")), " ")))).alias("j", "h"))
    anchors = staged(anchors, "bench-anchors")
    prints = staged(items.select("item_id", F.col("size").alias("size_i"), F.col("fingerprint").alias("fingerprint_i"), F.inline(blocks("fingerprint")).alias("block_i", "value_i")), "bench-prints")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST else df
    # Rows that share an id, or have none, are told apart by their texts; inside a struct a null id equals itself.
    key = F.struct(F.col(ident).alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    known = docs.select(key.alias("doc"), words(F.lower(F.col(text))).alias("_w"))
    rows = None
    for k in sorted({WORDS} | {r["k"] for r in items.select("k").distinct().collect()}):
        one = text_shingles(known, k)
        rows = one if rows is None else rows.unionByName(one)
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("j"), F.col("n") - F.col("size")))
    met = rows.join(small(anchors), ["k", "h"]).select("doc", "n", "item_id", "size", "k", start.alias("start")).distinct()
    before = F.lag("start").over(Window.partitionBy("doc", "n", "item_id").orderBy("start"))
    first = F.when(F.col("start") - F.col("before") <= F.col("size"), F.col("before") + 1).otherwise(F.col("start"))
    windows = met.withColumn("before", before).select("doc", "size", "k", F.explode(F.sequence(F.coalesce(first, F.col("start")), F.col("start"))).alias("start")).distinct()
    windows = staged(windows, "bench-windows")
    cut = windows.join(known, "doc").select("doc", "size", "k", "start", F.slice("_w", F.col("start") + 1, F.col("size")).alias("_v")).where(F.size("_v") >= F.col("k"))
    cut = cut.withColumn("shingles", shingle_array("_v", F.col("k"))).select("doc", "size", "start", "shingles")
    cut = staged(cut.withColumn("weight", weight_of("shingles")).withColumn("fingerprint", simhash("shingles")), "bench-cut")
    left = cut.select("doc", "size", "start", "shingles", "weight", "fingerprint", F.inline(blocks("fingerprint")).alias("block", "value"))
    met = left.join(small(prints), (F.col("size") == F.col("size_i")) & (F.col("block") == F.col("block_i")) & (F.col("value") == F.col("value_i")))
    apart = F.col("fingerprint").bitwiseXOR(F.col("fingerprint_i"))
    # Of the blocks a pair agrees in, the first alone passes the pair on.
    first = F.coalesce(*[F.when(F.call_function("shiftrightunsigned", apart, F.lit(a)).bitwiseAND(F.lit((1 << n) - 1).cast("long")) == 0, F.lit(b)) for b, (a, n) in enumerate(block_bounds())])
    near = met.where((F.bit_count(apart) <= RADIUS) & (F.col("block") == first))
    near = near.join(items.select("item_id", F.col("shingles").alias("shingles_i"), F.col("weight").alias("weight_i")), "item_id")
    common = F.aggregate(F.array_intersect("shingles", "shingles_i"), F.lit(0).cast("long"), lambda acc, x: acc + x["weight"])
    near = near.withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("weight") + F.col("weight_i") - F.col("common")))
    best = near.where(F.col("similarity") >= least).groupBy("doc", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("b"))
    return best.select("doc.doc_id", "item_id", (-F.col("b.at")).cast("long").alias("start"), F.col("b.similarity").alias("similarity"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT item_id, w, len(w) AS size, least(len(w), 5) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0
), di AS (
  SELECT doc_id, len(w) AS n, k, unnest(range(len(w) - k + 1)) AS p, w FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k
), ds AS (
  SELECT doc_id, n, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s FROM di
), ii AS (
  SELECT item_id, size, k, unnest(range(size - k + 1)) AS j, w FROM i
), si AS (
  SELECT item_id, size, k, j, array_to_string(w[j + 1 : j + k], ' ') AS s FROM ii
), aligned AS (
  SELECT DISTINCT ds.doc_id, si.item_id, si.size, si.k, greatest(0, least(p - j, n - si.size)) AS start
  FROM ds JOIN si ON ds.s = si.s AND ds.k = si.k
), neighbours AS (
  SELECT *, lag(start) OVER (PARTITION BY doc_id, item_id ORDER BY start) AS earlier FROM aligned
), win AS (
  SELECT DISTINCT doc_id, item_id, size, k, unnest(range(CASE WHEN start - earlier <= size THEN earlier + 1 ELSE start END, start + 1)) AS start FROM neighbours
), sets AS (
  SELECT win.doc_id, win.item_id, start,
         list_distinct(list_transform(range(least(win.size, len(d.w) - start) - win.k + 1), lambda x: array_to_string(d.w[start + x + 1 : start + x + win.k], ' '))) AS a,
         list_distinct(list_transform(range(win.size - win.k + 1), lambda x: array_to_string(i.w[x + 1 : x + win.k], ' '))) AS b
  FROM win JOIN d ON d.doc_id = win.doc_id JOIN i ON i.item_id = win.item_id
), weights AS (
  SELECT doc_id, item_id, start, list_sum(list_transform(a, lambda x: length(replace(x, ' ', '')))) AS wa, list_sum(list_transform(b, lambda x: length(replace(x, ' ', '')))) AS wb,
         coalesce(list_sum(list_transform(list_intersect(a, b), lambda x: length(replace(x, ' ', '')))), 0) AS wc
  FROM sets
), likeness AS (
  SELECT doc_id, item_id, start, CAST(wc AS DOUBLE) / CAST(wa + wb - wc AS DOUBLE) AS similarity FROM weights
)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, similarity FROM likeness WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

QUERIES = {"op8_decontamination": op8_decontamination}
SQL = {"op8_decontamination": OP8_SQL}
