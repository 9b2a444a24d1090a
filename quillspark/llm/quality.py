"""Quality rules: a threshold table compiled into one Spark projection.

`RULES` is the table: a rule's name, the ratio it bounds and its limits. `judged` adds every
count, ratio and verdict by built-in functions in the scan's own stage: no shuffle, no user
function, nothing that depends on other rows.

Repeated words are those inside 3-word windows that occur twice or more in the text. Windows are
sorted as (word, word, word, place) structs, neighbours that agree give the places of repeated
windows, and gaps between these places say how many words they cover. That is exact and takes
n log n in the text's length.

A null text counts as empty: all counts 0, `base_failed` true. A ratio over nothing is null and
breaks no rule; a ratio equal to a limit keeps it. Texts of any length are judged whole, each row by itself, so rows that
repeat get the same verdict. Extra columns pass through; one named like a count, `base_failed`, `kept` or
`broke_<rule>` is replaced, and names that start with `_` are for this module. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, table, words

#: Frequent function words of the corpus's languages.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "by", "for", "with", "on", "that", "are", "der", "die", "und", "von", "mit", "das", "den", "ist", "le", "la", "de", "et", "un", "que", "les", "des", "el", "en", "los", "del", "por")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`ratio` is a SQL expression over the counts; outside [least, most] the document goes."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 16.0),
    Rule("symbol_ratio", "n_symbols / n_words", most=0.25),
    Rule("stop_word_ratio", "n_stop_words / n_words", least=0.02),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", most=0.5),
    Rule("letter_word_ratio", "n_letter_words / n_words", least=0.6),
)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that rules are made of; the helper columns are arrays `_...`."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.length(F.translate(body, SPACE, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    df = docs.withColumn("_w", words(F.col(text))).withColumn("_lines", lines)
    df = (
        df.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", bare.cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_stop_words", F.regexp_count(ascii_lower(F.array_join("_w", " ")), F.lit(r"(?<!\S)(?:" + "|".join(STOP_WORDS) + r")(?!\S)")).cast("long"))
        .withColumn("n_letter_words", F.regexp_count(F.array_join("_w", " "), F.lit(r"(?<!\S)\P{L}*+\p{L}\S*+")).cast("long"))
    )
    return repeated(df).drop("_w", "_lines")


def repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words from the word array `_w`."""
    n = F.size("_w")
    m = F.greatest(n - 2, F.lit(0))
    some = F.when(n >= 4, F.arrays_zip(F.slice("_w", F.lit(1), m).alias("a"), F.slice("_w", F.lit(2), m).alias("b"), F.slice("_w", F.lit(3), m).alias("c"), F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))).alias("at")))
    df = df.withColumn("_sorted", F.sort_array(some))
    size = F.size("_sorted")
    df = df.withColumn("_pairs", F.when(size >= 2, F.arrays_zip(F.slice("_sorted", F.lit(1), size - 1).alias("x"), F.slice("_sorted", F.lit(2), size - 1).alias("y"))))
    same = F.filter("_pairs", lambda z: (z["x"]["c"] == z["y"]["c"]) & (z["x"]["b"] == z["y"]["b"]) & (z["x"]["a"] == z["y"]["a"]))
    df = df.withColumn("_same", same)
    places = F.sort_array(F.array_distinct(F.concat(F.col("_same")["x"]["at"], F.col("_same")["y"]["at"])))
    df = df.withColumn("_places", places)
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_places", zero, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")))["n"]
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_places") > 0, covered), F.lit(0)).cast("long")).drop("_sorted", "_pairs", "_same", "_places")


def verdicts(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One boolean `broke_<name>` column for each rule of the table."""
    out = []
    for rule in rules:
        ratio = F.expr(f"try_divide({rule.ratio.replace(' / ', ', ')})")
        low = ratio < rule.least if rule.least is not None else F.lit(False)
        high = ratio > rule.most if rule.most is not None else F.lit(False)
        out.append(F.coalesce(low | high, F.lit(False)).alias(f"broke_{rule.name}"))
    return out


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    df = counted(docs, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).select("*", *verdicts(rules))
    kept = ~F.col("base_failed")
    for rule in rules:
        kept = kept & ~F.col(f"broke_{rule.name}")
    return df.withColumn("kept", kept)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql_rules() -> str:
    broke = []
    for r in RULES:
        a, b = r.ratio.split(" / ")
        broke += [f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0) {sign} {limit}, false)" for sign, limit in (("<", r.least), (">", r.most)) if limit is not None]
    return " OR ".join(broke)


OP3_SQL = rf"""
WITH body AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM body
), three AS (
  SELECT doc_id, list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS t FROM split WHERE len(w) >= 3
), place AS (
  SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS t FROM three
), windowed AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM place
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM windowed, (SELECT unnest(range(3)) AS d) WHERE windowed.n > 1 GROUP BY doc_id
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce((SELECT c.n FROM covered c WHERE c.doc_id = split.doc_id), 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words
  FROM split
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT *, NOT (base_failed OR {_sql_rules()}) AS kept FROM failed
"""

QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL = {"op3_quality_rules": OP3_SQL}
