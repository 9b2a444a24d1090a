"""Ranked suggestions for unknown words.

Candidates share a deletion key with the word: one edit away means that deleting at most one letter
from each gives the same string, two edits at most two; so all within the distance are found. Known
words of more than `LONG` letters, which have very many deletions, are cut in one piece more than there
can be edits instead; one piece is whole in the word, moved by the distance at most. Keys are hashed, exploded and
joined, so no word meets the whole lexicon; the known words' keys are marked in a bit set of bounded size, which is broadcast, so that most
keys that no known word has never reach the shuffle. `levenshtein` then ranks, ties by length and spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.variants import german_variants
from ..sources.stage import staged
from . import similar
from .affix import Affixed
from .check import unknown
from .lexicon import AffixRules
from .marks import BITS, ROW  # noqa: F401
from .marks import known_by_bits as _known_by_bits

MOST = 5
VARIANT_QUERIES = 4
LONG = 20


def deletions(word: Column, distance: int = 1) -> Column:
    """The word and all it becomes without one letter, or up to two."""
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    n = F.char_length(word)
    none = F.array().cast("array<string>")
    one = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n)))).otherwise(none)
    both = [F.array(word), one]
    if distance == 2:
        pair = lambda i, j: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, j - i - 1), F.substr(word, j + 1, n))
        both.append(F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: pair(i, j))))).otherwise(none))
    return F.array_distinct(F.concat(*both))


def pieces(word: Column, distance: int) -> Column:
    """Keys of a known word: its length and `distance` + 1 pieces by place, one of which no edit touches."""
    n = F.char_length(word)
    return F.array(*[_piece(word, n, k, distance, F.lit(0)) for k in range(distance + 1)])


def _piece(word: Column, n: Column, k: int, distance: int, shift: Column) -> Column:
    """Piece k of known words with n letters, at its own place or moved."""
    start, stop = F.floor(n * k / (distance + 1)).cast("int"), F.floor(n * (k + 1) / (distance + 1)).cast("int")
    return F.concat_ws(" ", n.cast("string"), F.lit(str(k)), F.substr(word, start + shift + 1, stop - start))


def shifted_pieces(word: Column, distance: int) -> Column:
    """Keys of a word asked: where a piece of a known word of about its length can be."""
    by = range(-distance, distance + 1)
    n = F.char_length(word)
    return F.array_distinct(F.array(*[_piece(word, n + more, k, distance, F.lit(shift)) for more in by for k in range(distance + 1) for shift in by if k or shift >= 0]))


def ranked(queries: DataFrame, lexicon: DataFrame, distance: int = 2, most: int = MOST) -> DataFrame:
    """(word) and lexicon (dictionary, word, fold_key) -> (word, dictionary, rank, suggestion)."""
    asked = queries.select("word").distinct().withColumn("_key", X.fold_key(F.col("word")))
    known = lexicon.where("suggested") if "suggested" in lexicon.columns else lexicon
    known = known.select("dictionary", F.col("word").alias("suggestion"), F.col("fold_key").alias("_known")).distinct()
    n, m = F.char_length("_key"), F.char_length("_known")
    no = F.array().cast("array<string>")
    # Known words of up to LONG letters meet by deletions, longer ones by pieces.
    asked_keys = F.concat(F.when(n <= LONG + distance, deletions(F.col("_key"), distance)).otherwise(no), F.when(n > LONG - distance, shifted_pieces(F.col("_key"), distance)).otherwise(no))
    known_keys = F.when(m <= LONG, deletions(F.col("_known"), distance)).otherwise(pieces(F.col("_known"), distance))
    hashed = lambda keys: F.explode(F.transform(keys, lambda x: F.xxhash64(x))).alias("_cut")
    # Hashes are enough to meet by: pairs are verified before they are made distinct. Rows carry no more than their words.
    left = asked.select("word", hashed(asked_keys))
    right = known.select("dictionary", "suggestion", "_known", hashed(known_keys))
    left = _known_by_bits(left, right)
    # Keys are very many more than words, which Spark's estimate of sizes does not see: a broadcast of them would fill the driver.
    near = left.join(right.hint("merge"), "_cut").drop("_cut").withColumn("_key", X.fold_key(F.col("word"))).where((F.abs(n - m) <= distance) & (F.col("_key") != F.col("_known")))
    near = near.withColumn("_d", F.levenshtein("_key", "_known", distance)).where(F.col("_d") >= 0)
    near = near.select("word", "dictionary", "suggestion", (F.col("_d") * 8 + F.abs(n - m)).cast("byte").alias("_far"))
    # Pairs that met by several keys have one dense rank, so one shuffle both ranks them and makes them distinct.
    order = Window.partitionBy("word", "dictionary").orderBy("_far", "suggestion")
    top = near.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most).select("word", "dictionary", "rank", "suggestion").distinct()
    return top.select("word", "dictionary", "rank", X.recased(F.col("suggestion"), F.col("word")).alias("suggestion"))


def round_robin(lists: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """(keys, source, rank, item) -> (keys, items): first of each source, then second, ...; the first of equal items stays."""
    first = lists.groupBy(*keys, "item").agg(F.min(F.struct("rank", "source")).alias("at"))
    return first.groupBy(*keys).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), 1, most).alias("items"))


def by_dictionary(queries: DataFrame, lexicon: DataFrame, rules: dict[str, AffixRules], most: int = MOST) -> DataFrame:
    """(word) -> (word, dictionary, rank, suggestion): rewritings by a dictionary's rules, then words within two edits, then two words in one; for
    words with none of these in any dictionary, similar words."""
    lists = [ranked(queries, lexicon, most=most), similar.split_in_two(queries, lexicon, most)]
    lists = [x.withColumn("_stage", F.lit(k + 1)) for k, x in enumerate(lists)]
    for name, own in rules.items():
        lists.append(similar.rewritten(queries, lexicon.where(F.col("dictionary") == name), own, most).withColumn("_stage", F.lit(0)))
    near = lists[0]
    for other in lists[1:]:
        near = near.unionByName(other)
    near = staged(near)
    far = similar.similar(queries.select("word").distinct().join(near.select("word").distinct(), "word", "left_anti"), lexicon, most=most)
    rows = near.unionByName(far.withColumn("_stage", F.lit(3)))
    first = rows.groupBy("word", "dictionary", "suggestion").agg(F.min(F.struct("_stage", "rank")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("word", "dictionary").orderBy("_at", "suggestion"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("word", "dictionary", "rank", "suggestion")


def suggestions(queries: DataFrame, lexicon: DataFrame, order: list[str], most: int = MOST, german: tuple[str, ...] = (), parts: DataFrame | None = None, affixed: tuple[Affixed, ...] = (), rules: dict[str, AffixRules] | None = None) -> DataFrame:
    """(word) -> (word, suggestions) over all dictionaries in their order; words that a lexicon has get none.

    Suggestions are known words within two edits; with `rules` (by dictionary, may be empty) also rewritings, two words in one and similar words.

    `german` names the dictionaries that also know words by readings with umlauts, and are asked for these.
    """
    read = F.col("dictionary").isin(*german) if german else F.lit(False)
    asked = queries.select("word").distinct().withColumn("fold_key", X.fold_key(F.col("word")))
    checked = lexicon.where(~F.col("dictionary").isin(*[d.dictionary for d in affixed])) if affixed else lexicon
    asked = unknown(asked, checked, checked.where(read) if german else None, parts, affixed, german)
    place = F.create_map(*[F.lit(v) for k, d in enumerate(order) for v in (d, k)])
    if rules is None:
        found = ranked(asked, lexicon.where(~read), most=most)
    else:
        asked = staged(asked)
        found = by_dictionary(asked, lexicon.where(~read), {k: r for k, r in rules.items() if k not in german}, most)
    lists = found.select("word", place[F.col("dictionary")].alias("source"), "rank", F.col("suggestion").alias("item"))
    for name in german:
        own = german_suggestions(asked, lexicon.where(F.col("dictionary") == name), most)
        lists = lists.unionByName(own.select("word", place[F.lit(name)].alias("source"), F.posexplode("suggestions").alias("rank", "item")).withColumn("rank", F.col("rank") + 1))
    return round_robin(lists, ["word"], most).withColumnRenamed("items", "suggestions")


def german_suggestions(queries: DataFrame, lexicon: DataFrame, most: int = MOST) -> DataFrame:
    """As `suggestions`, asking also for readings with umlauts: all pairs read, the word, then partial readings."""
    variants = german_variants(F.col("word"))
    asked = queries.select("word").distinct().withColumn("_v", variants)
    last = F.size("_v")
    wanted = F.when(last > 0, F.concat(F.array(F.struct(F.lit(0).alias("source"), F.element_at("_v", -1).alias("ask"))), F.array(F.struct(F.lit(1).alias("source"), F.col("word").alias("ask"))), F.transform(F.slice(F.reverse(F.slice("_v", F.lit(1), F.greatest(last - 1, F.lit(0)))), F.lit(1), F.lit(VARIANT_QUERIES - 1)), lambda v, i: F.struct((i + 2).alias("source"), v.alias("ask"))))).otherwise(F.array(F.struct(F.lit(0).alias("source"), F.col("word").alias("ask"))))
    asks = asked.select("word", F.inline(wanted))
    hits = asks.join(lexicon.select(F.col("word").alias("item"), "fold_key"), X.fold_key(F.col("ask")) == F.col("fold_key")).select("word", "source", F.lit(0).alias("rank"), "item")
    near = ranked(asks.select(F.col("ask").alias("word")), lexicon, most=most).withColumnRenamed("word", "ask")
    rows = asks.join(near, "ask").select("word", "source", "rank", F.col("suggestion").alias("item")).unionByName(hits)
    # Sources one after the other, not in turns.
    firsts = rows.groupBy("word", "item").agg(F.min(F.struct("source", "rank")).alias("at"))
    return firsts.groupBy("word").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), 1, most).alias("suggestions"))
