"""Findings: words that are flagged, or unknown to every lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.variants import german_variants
from ..sources.stage import staged
from . import affix, compound_rules
from .affix import Affixed
from .compounds import known_compounds

#: Rows of a lexicon that may be broadcast; beyond, the equi-join on fold keys shuffles.
BROADCAST = 2_000_000


def sized(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A broadcast hint if the table, counted up to the bound, is within it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def folded_in(key: Column, words: tuple[str, ...]) -> Column:
    """Whether a fold key is one of a setting's words."""
    import functools

    keys = [X.fold_key(F.lit(w)) for w in dict.fromkeys(words)]
    return functools.reduce(lambda a, b: a | b, (key == k for k in keys), F.lit(False))


def known_by(words: DataFrame, dictionary: Affixed) -> DataFrame:
    """The distinct words (word) that an affix dictionary has: by stripping, or as compounds by rule."""
    found = affix.accepted(words, dictionary)
    return found.unionByName(compound_rules.accepted(words, dictionary)) if dictionary.rules.compounds else found


def unknown(distinct: DataFrame, lexicon: DataFrame, german: DataFrame | None = None, parts: DataFrame | None = None, affixed: tuple[Affixed, ...] = (), german_affixed: tuple[str, ...] = ()) -> DataFrame:
    """Distinct words (word, fold_key) that no lexicon has, nor a dictionary of `affixed`; with `german`, nor by a spelling without umlauts; with `parts`, nor as compounds.

    `german_affixed` names the dictionaries of `affixed` that know such spellings too.
    """
    left = distinct.join(sized(lexicon.select("fold_key").distinct()), "fold_key", "left_anti")
    if affixed:
        left = staged(left)  # some words of the text's; each dictionary asks for them
    for dictionary in affixed:
        left = left.join(known_by(left, dictionary), "word", "left_anti")
    if parts is not None:
        left = left.join(known_compounds(left, parts), "word", "left_anti")
    read = [d for d in affixed if d.dictionary in german_affixed]
    if german is None and not read:
        return left
    variants = left.select("word", F.explode(german_variants(F.col("word"))).alias("variant"))
    if german is not None:
        known = variants.select("word", X.fold_key(F.col("variant")).alias("fold_key")).join(sized(german.select("fold_key").distinct()), "fold_key", "left_semi").select("word").distinct()
        left = left.join(known, "word", "left_anti")
    for dictionary in read:
        found = known_by(variants.select(F.col("variant").alias("word")), dictionary).withColumnRenamed("word", "variant")
        left = left.join(variants.join(found, "variant").select("word").distinct(), "word", "left_anti")
    return left


def findings(words: DataFrame, lexicon: DataFrame, key: str = "doc_id", flag: tuple[str, ...] = (), allow: tuple[str, ...] = (), min_length: int = 3, german: DataFrame | None = None, parts: DataFrame | None = None, affixed: tuple[Affixed, ...] = (), german_affixed: tuple[str, ...] = ()) -> DataFrame:
    """(key, word, start_byte, end_byte) -> (key, word, locations).

    Each distinct word is looked up once: distinct words are formed by partial aggregation, cut by the
    cheap rules first, and only what is left meets the lexicons. Flagged words pass whatever else holds.
    """
    distinct = words.select("word").distinct().withColumn("fold_key", X.fold_key(F.col("word")))
    flagged = folded_in(F.col("fold_key"), flag)
    plain = distinct.where(~flagged & (F.char_length("word") >= min_length) & ~folded_in(F.col("fold_key"), allow))
    bad = unknown(plain, lexicon, german, parts, affixed, german_affixed).select("word")
    if flag:
        bad = bad.unionByName(distinct.where(flagged).select("word"))
    located = words.join(bad, "word", "left_semi")
    return located.groupBy(key, "word").agg(F.array_sort(F.collect_set(F.struct("start_byte", "end_byte"))).alias("locations"))


def counted(rows: DataFrame, lexicon: DataFrame, by: list[str], flag: tuple[str, ...] = (), allow: tuple[str, ...] = (), min_length: int = 3) -> DataFrame:
    """(by..., word, n, d) -> (by..., word, n_docs, n_occurrences) of the findings: sums of d and n."""
    totals = rows.groupBy(*by, "word").agg(F.sum("d").alias("n_docs"), F.sum("n").alias("n_occurrences"))
    keyed = totals.withColumn("fold_key", X.fold_key(F.col("word")))
    flagged = folded_in(F.col("fold_key"), flag)
    plain = keyed.where(~flagged & (F.char_length("word") >= min_length) & ~folded_in(F.col("fold_key"), allow)).join(sized(lexicon.select("fold_key").distinct()), "fold_key", "left_anti")
    out = plain.unionByName(keyed.where(flagged)) if flag else plain
    return out.drop("fold_key")
