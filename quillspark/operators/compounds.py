"""Words put together from the parts that an affix dictionary allows in compounds.

A part is (dictionary, part, first, inner, last): a folded form and the places it may have. Only unknown distinct words are
tried: their substrings of the parts' lengths meet the parts in one equi-join, and what was found of a word is followed
from its first letter to its last in its own row. So no compound is ever written out, and a word of any length costs its
length times the number of lengths that parts have.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .lexicon import AffixRules, forms, read_pair

#: Parts that may be broadcast; beyond, the join shuffles.
BROADCAST = 500_000
PLACES = ("first", "inner", "last")


def parts(stems: DataFrame, rules: AffixRules, dictionary: str) -> DataFrame:
    """Lines `word[/flags]` -> (dictionary, part, first, inner, last), parts of the least length or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                stem, _, flags = line.split("\t")[0].strip().partition("/")
                if stem:
                    rows.extend((word, *(p in places for p in PLACES)) for word, places in forms(rules, stem, rules.flags(flags.strip())).items() if places)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(x, pa.bool_()) for x in columns[1:])], names=["word", *PLACES])

    rows = stems.select("value").mapInArrow(run, "word string, first boolean, inner boolean, last boolean")
    keyed = rows.withColumn("part", X.fold_key(F.col("word"))).where(F.char_length("part") >= rules.compound_min)
    return keyed.groupBy(F.lit(dictionary).alias("dictionary"), "part").agg(*[F.max(p).alias(p) for p in PLACES])


def known_compounds(words: DataFrame, known: DataFrame) -> DataFrame:
    """Of (word, fold_key), the words that are two parts or more of one dictionary, each at a place it may have."""
    shortest, longest = known.agg(F.min(F.char_length("part")), F.max(F.char_length("part"))).first()
    asked = words.select("word", "fold_key").distinct()
    if longest is None:
        return asked.select("word").limit(0)
    n = F.char_length("fold_key")
    at = F.when(n > shortest, F.sequence(F.lit(1), n - shortest + 1)).otherwise(F.array().cast("array<int>"))
    starts = asked.select("word", "fold_key", n.alias("_n"), F.explode(at).alias("_start"))
    most = F.least(F.lit(longest), F.col("_n") - F.col("_start") + 1)
    pieces = starts.select("word", "_n", "_start", F.substr("fold_key", F.col("_start"), F.lit(longest)).alias("_rest"), F.explode(F.sequence(F.lit(shortest), most)).alias("_size"))
    pieces = pieces.select("word", "_n", "_start", (F.col("_start") + F.col("_size")).alias("_stop"), F.substr("_rest", F.lit(1), F.col("_size")).alias("part"))
    # A part fits where a word begins, ends or goes on; most substrings fit nowhere and end here.
    is_first, is_last = F.col("_start") == 1, F.col("_stop") == F.col("_n") + 1
    fits = (is_first & F.col("first") & ~is_last) | (is_last & F.col("last") & ~is_first) | (~is_first & ~is_last & F.col("inner"))
    found = pieces.join(F.broadcast(known) if known.limit(BROADCAST + 1).count() <= BROADCAST else known, "part").where(fits)
    # Steps by their starts: all that end at a place come before those that begin there.
    steps = found.groupBy("word", "dictionary", "_n").agg(F.array_sort(F.collect_set(F.struct("_start", "_stop"))).alias("_steps"))
    reached = F.aggregate("_steps", F.array(F.lit(1)), lambda done, s: F.when(F.array_contains(done, s["_start"]), F.array_union(done, F.array(s["_stop"]))).otherwise(done))
    return steps.where(F.array_contains(reached, F.col("_n") + 1)).select("word").distinct()


def local_parts(spark: SparkSession, folder: str, dictionary: str) -> DataFrame | None:
    """The parts of `<id>.aff` and `<id>.dic`; None without the pair, with a word list in its stead, or if it forms no compounds."""
    base = Path(folder) / dictionary
    aff, dic = base.with_suffix(".aff"), base.with_suffix(".dic")
    if base.with_suffix(".txt").is_file() or not (aff.is_file() and dic.is_file()):
        return None
    rules, lines = read_pair(spark, f"file://{aff.resolve()}", f"file://{dic.resolve()}")
    return parts(lines, rules, dictionary) if rules.places else None
