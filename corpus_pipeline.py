"""A training corpus from `documents` in five stages, each written as Parquet and read again.

Language ID drops texts without a language; the n-gram Jaccard join keeps one document of each
group; benchmark decontamination drops documents with a benchmark passage; mixing repeats and drops
whole documents until sources have their shares; the last stage writes the token files and returns
their documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, jaccard, langid, mixing, tokens

#: A text whose best language is above chance by less than this part of what is left is in none of the learned languages.
LEAST_MARGIN = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops `und` (no text, no letters) and texts of which the network says little more than chance.

    With L languages, chance is 1 / L; with one language alone every text with letters fits it.
    """
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    lang, score = common.free_name(docs, "lang_pred"), common.free_name(docs, "lang_score")
    found = langid.identified(docs, model, names=(lang, score))
    chance = 1 / len(model.labels) if model else 0.0
    return found.where((F.col(lang) != "und") & (F.col(score) >= chance + LEAST_MARGIN * (1 - chance))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document whose id names its group; of rows that repeat an id one, the least by text. A null id is in no group."""
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"))
    by_id = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    leave = common.staged(by_id.where("doc_id <> component_id OR n > 1").select("doc_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("n") > 1)).alias("again")), "leave")
    once = docs.join(leave.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    again = docs.join(leave.where("again").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("r")).select("r.*")
    return once.unionByName(again)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a passage of a benchmark item; rows with one id, or with none, are judged each by its text."""
    key, name = F.struct("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), common.free_name(docs, "_key")
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    found = common.staged(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(found, key == F.col(name), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents that share an id are one to the mix: the copies of one of them are those of all.
    """
    ident, n, copy = (common.free_name(docs, x) for x in ("_id", "_copies", "_copy"))
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias(ident)).agg(F.max("copies").alias(n))
    repeated = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(ident))).where(F.col(n) > 0)
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.op9_token_files(spark, sf_dir, docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]

#: SQL cannot express a trained classifier; tests hold each stage against its own plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
