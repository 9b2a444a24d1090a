"""Suggestions that are not a matter of edits: rewritings, two words in one, and similar words.

* `rewritten`: a dictionary's replacements (`REP`, in their order; `^` and `$` hold one to the word's ends, `_` is a space)
  and related letters (`MAP`), each applied at one place. Substrings of an unknown word meet the table of what is replaced in
  an equi-join, and what comes of it meets the lexicon. A replacement with a space asks for both words.
* `split_in_two`: each way to cut a word in two meets the lexicon by its beginning, and what is left by its end. Of both, what has no mark of a
  known word is left out before; the rest is dealt over as many tasks as the words asked have letters for, LETTERS each (about).
* `similar`: weighted Jaccard similarity of letter trigrams, for words that nothing else is near. A trigram's weight grows with its
  rarity, in whole thousandths, so sums are exact. At a low `least` most pairs of words share a trigram, so no pair is made a row:
  parts of the words asked meet parts of the known words, ASKED and GIVEN words at most (about), in tasks that add up the weights of common trigrams
  by postings and return the few nearest of each part. The work is that of all postings; the memory is that of two parts.

Each is a ranked list by dictionary; `suggest.suggestions` puts them behind one another and then takes
dictionaries in turns. Null and empty words have no suggestions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stage import staged
from .lexicon import AffixRules
from .marks import known_by_bits

MOST = 5
#: The least similarity, in hundredths.
LEAST = 30
#: Letters of the words asked, each a place to cut or replace at, and rows of a lexicon that one task takes.
LETTERS = 1 << 20
#: Words in a part of those asked, and rows in a part of the known words.
ASKED, GIVEN = 20_000, 50_000
#: Bits of a weight, which is 1000 * ln(1 + words of the lexicon) at most.
WEIGHT_BITS = 16


def _known(lexicon: DataFrame) -> DataFrame:
    known = lexicon.where("suggested") if "suggested" in lexicon.columns else lexicon
    return known.select("dictionary", F.col("word").alias("suggestion"), F.col("fold_key").alias("_known")).distinct()


def _asked(queries: DataFrame, parts: int | None = None) -> DataFrame:
    words = queries.select("word").where("word <> ''")
    return (words.repartition(parts, "word") if parts else words).distinct().withColumn("_key", X.fold_key(F.col("word")))


def _parts(queries: DataFrame, known: DataFrame) -> int:
    """How many tasks the words asked and the known words need, whatever the session's number of partitions."""
    letters = queries.agg(F.sum(F.char_length("word"))).first()[0] or 0
    return max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(letters / LETTERS), math.ceil(known.count() / LETTERS))


def _marked(rows: DataFrame, known: DataFrame, *columns: Column) -> DataFrame:
    """The rows whose columns may all be known words."""
    keys = known.select(F.xxhash64("_known").alias("_cut"))
    for column in columns:
        rows = known_by_bits(rows.withColumn("_cut", F.xxhash64(column)), keys).drop("_cut")
    return rows


def _met(rows: DataFrame, known: DataFrame, parts: int, *more: str) -> DataFrame:
    """rows with the known words that are their `_known`: a task holds its part of the lexicon, and rows pass by, however many have one key."""
    by = ["_known", *more]
    return rows.repartition(parts, *by).join(known.repartition(parts, *by).hint("shuffle_hash"), by)


def _top(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first of equal suggestions stays; (word, dictionary, rank, suggestion)."""
    rank = F.row_number().over(Window.partitionBy("word", "dictionary").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("word", "dictionary", "rank", X.recased(F.col("suggestion"), F.col("word")).alias("suggestion"))


def replacements(rules: AffixRules) -> list[tuple[str, str, bool, bool, int]]:
    """(from, to, at the beginning only, at the end only, place): `REP` in order, then the pairs of each group of `MAP`."""
    out = [(a.removeprefix("^").removesuffix("$").lower(), b.lower(), a.startswith("^"), a.endswith("$")) for a, b in rules.replacements]
    out += [(a.lower(), b.lower(), False, False) for group in rules.related for a in group for b in group if a != b]
    return [(*r, k) for k, r in enumerate(out) if r[0]]


def rewritten(queries: DataFrame, lexicon: DataFrame, rules: AffixRules, most: int = MOST) -> DataFrame:
    """(word) -> (word, dictionary, rank, suggestion), by the replacement's place in the table, then its place in the word."""
    spark, rows = queries.sparkSession, replacements(rules)
    empty = "word string, dictionary string, rank int, suggestion string"
    if not rows:
        return spark.createDataFrame([], empty)
    table = F.broadcast(spark.createDataFrame(rows, "_cut string, _to string, _first boolean, _last boolean, _place int"))
    known = staged(_known(lexicon))
    parts = _parts(queries, known)
    n = F.char_length("_key")
    sizes = F.array(*[F.lit(k) for k in sorted({len(r[0]) for r in rows})])
    cut = _asked(queries, parts).withColumn("_size", F.explode(sizes)).where(n >= F.col("_size")).withColumn("_at", F.explode(F.sequence(F.lit(1), n - F.col("_size") + 1)))
    cut = cut.withColumn("_cut", F.substr("_key", F.col("_at"), F.col("_size")))
    met = cut.join(table, "_cut").where((~F.col("_first") | (F.col("_at") == 1)) & (~F.col("_last") | (F.col("_at") + F.col("_size") == n + 1)))
    made = F.concat(F.substr("_key", F.lit(1), F.col("_at") - 1), F.col("_to"), F.substr("_key", F.col("_at") + F.col("_size"), n))
    made = met.select("word", "_place", "_at", F.split(made, " ").alias("_words")).where(F.size("_words") <= 2)
    made = _marked(made, known, F.get("_words", F.lit(0)), F.element_at("_words", -1))
    first = staged(_met(made.withColumn("_known", F.get("_words", F.lit(0))), known, parts).drop("_known"))  # read for one word and for two
    second = _met(first.where(F.size("_words") == 2).withColumn("_known", F.get("_words", F.lit(1))).withColumnRenamed("suggestion", "_one"), known, parts, "dictionary")
    both = second.select("word", "_place", "_at", "dictionary", F.concat_ws(" ", "_one", "suggestion").alias("suggestion"))
    found = first.where(F.size("_words") == 1).select("word", "_place", "_at", "dictionary", "suggestion").unionByName(both)
    best = found.repartition(parts, "word", "dictionary").groupBy("word", "dictionary", "suggestion").agg(F.min(F.struct("_place", "_at")).alias("_best"))
    return _top(best, [F.col("_best"), F.col("suggestion")], most)


def split_in_two(queries: DataFrame, lexicon: DataFrame, most: int = MOST) -> DataFrame:
    """(word) -> (word, dictionary, rank, suggestion): two known words of one dictionary, the most even cut first."""
    known = staged(_known(lexicon))
    parts = _parts(queries, known)
    n = F.char_length("_key")
    cuts = _asked(queries, parts).where(n > 1).withColumn("_at", F.explode(F.sequence(F.lit(1), n - 1)))
    cuts = cuts.select("word", F.abs(2 * F.col("_at") - n).alias("_odd"), F.substr("_key", F.lit(1), F.col("_at")).alias("_known"), F.substr("_key", F.col("_at") + 1, n).alias("_rest"))
    cuts = _marked(cuts, known, F.col("_known"), F.col("_rest"))
    first = _met(cuts, known, parts).select("word", "_odd", "dictionary", F.col("suggestion").alias("_one"), F.col("_rest").alias("_known"))
    both = _met(first, known, parts, "dictionary").select("word", "_odd", "dictionary", F.concat_ws(" ", "_one", "suggestion").alias("suggestion"))
    return _top(both.repartition(parts, "word", "dictionary").distinct(), [F.col("_odd"), F.col("suggestion")], most)


def grams(key: Column) -> Column:
    """The distinct letter trigrams of a word between two spaces."""
    text = F.concat(F.lit(" "), key, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))


def _weighed(words: DataFrame, key: str, weights: DataFrame, heaviest: int) -> DataFrame:
    """(key) -> (key, codes of the trigrams that known words have, total): a code is a trigram's number and, in the last WEIGHT_BITS, its weight."""
    each = words.select(key, F.explode(grams(F.col(key))).alias("gram")).join(weights, "gram", "left")
    return each.groupBy(key).agg(F.collect_list(F.shiftleft("number", WEIGHT_BITS) + F.col("weight")).alias("codes"), F.sum(F.coalesce("weight", F.lit(heaviest))).alias("total"))


def _nearest(least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a part of the words asked and a part of the known ones: by word asked and dictionary, the `most` nearest known words."""

    def flat(codes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, weight) of each code."""
        lists = codes.combine_chunks()
        each = lists.flatten().to_numpy()
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), each >> WEIGHT_BITS, each & ((1 << WEIGHT_BITS) - 1)

    def answer(rows: list[tuple]) -> pa.Table:
        fields = (("_key", pa.string()), ("dictionary", pa.string()), ("suggestion", pa.string()), ("_like", pa.float64()))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(fields)})

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows or not given.num_rows:
            return answer([])
        # In the order of suggestions, by their bytes, so that of equals the first is the least.
        spelt = [x.encode() for x in given["suggestion"].to_pylist()]
        given = given.take(pa.array(sorted(range(len(spelt)), key=spelt.__getitem__), pa.int64()))
        rows, number, weight = flat(given["codes"])
        order = np.argsort(number, kind="stable")
        numbers, first = np.unique(number[order], return_index=True)
        posted, heavy, last = rows[order], weight[order], np.append(first[1:], len(order))
        totals, suggestions = given["_total"].to_numpy(), given["suggestion"].to_pylist()
        dictionaries = given["dictionary"].combine_chunks().dictionary_encode()
        names, of = dictionaries.dictionary.to_pylist(), dictionaries.indices.to_numpy()
        alone: dict[str, list[int]] = {}
        for j, x in enumerate(given["_known"].to_pylist()):
            alone.setdefault(x, []).append(j)
        asked_rows, wanted, _ = flat(asked["codes"])
        place = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
        asked_rows, place = asked_rows[numbers[place] == wanted], place[numbers[place] == wanted]
        bounds = np.searchsorted(asked_rows, np.arange(asked.num_rows + 1))
        out: list[tuple] = []
        for k, (key, total) in enumerate(zip(asked["_key"].to_pylist(), asked["_total"].to_pylist(), strict=True)):
            mine = place[bounds[k] : bounds[k + 1]]
            if not len(mine):
                continue
            met = np.concatenate([posted[first[g] : last[g]] for g in mine])
            common = np.bincount(met, np.repeat(heavy[first[mine]], last[mine] - first[mine]), len(totals))
            common[alone.get(key, [])] = 0
            # Those that are alike enough: first as if all were as light as the lightest, then each by its own total.
            some = np.flatnonzero((common > 0) & (common * (100 + least) >= (total + totals.min()) * least))
            shared = common[some].astype(np.int64)
            union = total + totals[some] - shared
            good = shared * 100 >= union * least
            some, like = some[good], shared[good] / union[good]
            for d, name in enumerate(names):
                own, alike = some[of[some] == d], like[of[some] == d]
                if len(own) > most:
                    enough = alike >= np.partition(alike, -most)[-most]
                    own, alike = own[enough], alike[enough]
                out += [(key, name, suggestions[own[j]], float(alike[j])) for j in np.argsort(-alike, kind="stable")[:most]]
        return answer(out)

    return run


def similar(queries: DataFrame, lexicon: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word) -> (word, dictionary, rank, suggestion) with a similarity of `least` hundredths or more, the most similar first."""
    known = staged(_known(lexicon))
    keys = known.select("_known").distinct()
    number = keys.count()
    share = F.lit(float(number)) / F.col("n")
    weights = keys.select(F.explode(grams(F.col("_known"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    weights = staged(weights.select("gram", F.round(1000 * F.log(1 + share)).cast("long").alias("weight"), F.monotonically_increasing_id().alias("number")))
    heaviest = round(1000 * math.log(1 + number))
    asked = staged(_weighed(_asked(queries).select("_key").distinct(), "_key", weights, heaviest).withColumnRenamed("total", "_total"))
    given = staged(known.join(_weighed(keys, "_known", weights, heaviest).withColumnRenamed("total", "_total"), "_known"))
    # Every part of the words asked meets every part of the known ones.
    parts, blocks = (max(1, math.ceil(n / size)) for n, size in ((asked.count(), ASKED), (given.count(), GIVEN)))
    part, block = F.pmod(F.xxhash64("_key"), F.lit(parts)), F.pmod(F.xxhash64("suggestion"), F.lit(blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(part.alias("_part"), each(blocks).alias("_block"), "_key", "_total", "codes")
    right = given.select(each(parts).alias("_part"), block.alias("_block"), "dictionary", "suggestion", "_known", "_total", "codes")
    scored = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(_nearest(least, most), "_key string, dictionary string, suggestion string, _like double")
    rank = F.row_number().over(Window.partitionBy("_key", "dictionary").orderBy(F.desc("_like"), "suggestion"))
    nearest = scored.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    return _top(_asked(queries).join(nearest, "_key"), [F.desc("_like"), F.col("suggestion")], most)
