"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. In a source, documents have unequal multiplicities: a level
times their weight, which grows with the length of the text (`weight_of`), and no more than the most copies; the level is
the one at which the source's expected words are its target. The whole part of a multiplicity is
taken for certain, and the fraction is an inclusion probability p. Remainders are drawn by Pareto
order sampling: with U uniform in (0, 1) per document, documents are ranked by
(U / (1 - U)) / (p / (1 - p)) and the smallest are taken until the words of the remainder are met, so
the sample's size is fixed and each document's probability is its own.

The cut in that order is found without sorting a source in one task. A histogram of words over
`BUCKETS` equal ranges of the rank (at most that many rows a source) shows the one range the cut
falls in; only that range's documents are ordered. Whatever the size of a source, a task gets
a 1/BUCKETS part of it at most.

U comes from a digest of the document's id, so reruns agree. Rows that repeat an id are ranked
by their size next; rows equal in both are interchangeable. A null source is a source of its own,
ordered last; a null or empty text has size 0, takes 0 words, and does not change a sample. A text
of any length is one document and is taken whole or not at all, so a source's words are within half a document of
its target. An empty table gives an empty mix. `pareto_copies` passes all columns of its rows through, whatever
their names, but for one named `copies`, which it replaces; `mix` returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, staged, table

#: Fixed values of the mix that op10 makes.
WEIGHTS = (5, 2, 1)
SHARE_NUM, SHARE_DEN = 3, 2  # the mix has 150% of all words
MOST_COPIES = 2

BUCKETS = 1024
SALTS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, num: int = SHARE_NUM, den: int = SHARE_DEN, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources in code point order, null last, weigh `weights` in turn. The target is
    min(most * size, level * weight), with the one level at which targets sum to num/den of all
    sizes: what sharing the excess again and again arrives at. The level is found from running
    sums in the order in which sources reach their cap. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((n - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("pos", n).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("pos"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(num) / float(den) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    first = F.min(F.when(fits, F.struct("rank", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("first", first).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("first") * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the seed and the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def with_group(rows: DataFrame, groups: DataFrame, column: str, group: str, how: str, spread: str = "doc_id") -> DataFrame:
    """rows joined to the one row of their group, null groups too.

    A group may hold a third of all rows, so its row is there SALTS times and its rows are dealt to
    these by a hash: no task gets more than a SALTS part of a group.
    """
    many = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    joined = dealt.join(many, (F.col("_own") == F.col("_salt")) & dealt[column].eqNullSafe(many[group]), how)
    return joined.drop("_own", "_salt", group)


def weight_of(size: Column) -> Column:
    """1, and a quarter for each binary digit of the number of words; a multiple of 1/4 is exact in sums."""
    return 1 + F.when(size > 0, F.length(F.bin(size))).otherwise(0) / F.lit(4.0)


def levels(sizes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, size) and (source, source_size, target) -> targets with the level of each source.

    A document of a weight has multiplicity min(most, level * weight). Weights are few, so a source has some dozens of rows;
    running sums in the order in which weights reach the cap show the level, null where all are there.
    """
    by_weight = sizes.groupBy("source", weight_of(F.col("size")).alias("weight")).agg(F.sum("size").alias("words"))
    rows = by_weight.join(targets, by_weight["source"].eqNullSafe(targets["source"])).drop(by_weight["source"])
    source = Window.partitionBy("source")
    order = source.orderBy(F.desc("weight"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("words") * F.col("weight")).over(rest)
    found = rows.where("words > 0").withColumn("level", level).where((F.col("target") < most * F.col("source_size")) & (F.col("level") * F.col("weight") <= most))
    first = found.groupBy("source").agg(F.max_by("level", "weight").alias("level"))
    return targets.join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def pareto_copies(docs: DataFrame, group: str, size: str, multiplicity: str, ident: str = "doc_id", seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """docs with `copies`: whole copies for certain, one more where the Pareto sample takes it.

    `multiplicity` may differ from document to document; the sample of a group has
    the fractions' expected words, to half a document.
    """
    own = [c for c in docs.columns if c.lower() != "copies"]
    m, u = F.col(multiplicity), uniform(F.col(ident), seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(group).alias("g"), F.col(size).alias("size"), F.col(ident).alias("id"), F.floor(m).cast("long").alias("whole"), (m - F.floor(m)).alias("p"), u.alias("u"))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.withColumn("rank", F.when(F.col("p") > 0, rank)).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).cast("int"))
    hist = ranked.where("p > 0").groupBy(F.col("g").alias("g_"), F.col("bucket").alias("cut")).agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("p")).alias("share"))
    by_group = Window.partitionBy("g_")
    up_to = by_group.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    # Sums of fractions differ in their last digits with the order of addition.
    cut = (
        hist.withColumn("need", F.round(F.sum("share").over(by_group), 3)).withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
        .where("before <= need AND need < before + words").select("g_", "cut", "need", "before")
    )
    # One row a group; with no cut row the whole remainder is taken (nothing is left over).
    joined = with_group(ranked, cut, "g", "g_", "left", "id")
    there = F.col("bucket") == F.col("cut")
    order = Window.partitionBy("g").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.where(there).withColumn("extra", (F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("need")).cast("long"))
    outside = joined.where(~F.coalesce(there, F.lit(False))).withColumn("extra", F.when(F.col("p") > 0, F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)).cast("long")).otherwise(0))
    return inside.unionByName(outside).select("row.*", (F.col("whole") + F.col("extra")).alias("copies"))


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """docs -> (doc_id, source, size, source_size, target, multiplicity, copies), one row for each row of docs.

    The word counts are staged, as they are read three times and the texts should be read once.
    """
    sizes = staged(docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    targets = staged(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    known = with_group(sizes, levels(sizes, targets).withColumnRenamed("source", "_source"), "source", "_source", "inner")
    m = F.least(F.lit(float(MOST_COPIES)), F.coalesce(F.col("level") * weight_of(F.col("size")), F.lit(float(MOST_COPIES))))
    known = known.withColumn("multiplicity", F.when(F.col("source_size") > 0, m).otherwise(0.0)).drop("level")
    return pareto_copies(known, "source", "size", "multiplicity", seed=seed)


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 3.0::DOUBLE / 2.0::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), target AS (
  SELECT source, source_size, least(cap, (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, pos LIMIT 1) * weight) AS target FROM levels
), lengths AS (
  SELECT source, 1 + CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END / 4.0::DOUBLE AS weight, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY 1, 2 HAVING sum(size) > 0
), capped AS (
  SELECT l.source, l.weight, t.target, t.source_size,
         (t.target - 2 * coalesce(sum(words) OVER (PARTITION BY l.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(words * weight) OVER (PARTITION BY l.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM lengths l JOIN target t ON l.source IS NOT DISTINCT FROM t.source
), level AS (
  SELECT source, arg_max(level, weight) AS level FROM capped WHERE target < 2 * source_size AND level * weight <= 2 GROUP BY source
), drawn AS (
  SELECT s.doc_id, s.size, t.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, coalesce(l.level * (1 + CASE WHEN s.size > 0 THEN length(bin(s.size)) ELSE 0 END / 4.0::DOUBLE), 2.0::DOUBLE)) ELSE 0 END AS m,
         (CAST(('0x' || substr(md5('mix|' || s.doc_id), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN level l ON l.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, m - floor(m) AS p, (u / (1 - u)) / nullif((m - floor(m)) / (1 - (m - floor(m))), 0) AS k FROM drawn
), running AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         round(sum(size * p) OVER (PARTITION BY source), 3) AS need
  FROM ranked WHERE p > 0
  UNION ALL SELECT *, 0, 0 FROM ranked WHERE p = 0
)
SELECT doc_id, size, source_size, target, CAST(size * c AS BIGINT) AS taken, c AS copies
FROM (SELECT *, CAST(floor(m) AS BIGINT) + CASE WHEN p > 0 AND before + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END AS c FROM running)
"""

QUERIES = {"op10_pareto_mix": op10_pareto_mix}
SQL = {"op10_pareto_mix": OP10_SQL}
