"""Affix dictionaries as relations: words are stripped to stems, no dictionary is expanded.

An affix rule (strip, add, condition, flag) is a row keyed by the end that it adds, or the beginning. An unknown
word's ends meet these rows in an equi-join; what is left, with what the rule had stripped put back, is stripped once more by rules
whose flag another rule carries on (continuation classes), loses a prefix, and meets the stems in an
equi-join on fold keys. What met is then judged as it is written: flags, conditions and case are
checked on the stem and the forms that the rules make of it.

A reading is a stem with at most one prefix and two suffixes:

* a suffix's flag is one of the stem's, or the prefix carries it; a second suffix's is carried by the first; a prefix's is
  one of the stem's or carried by a suffix; prefix and suffixes together need rules that cross (`Y`);
* `NEEDAFFIX` on a stem asks for an affix, on an affix for another one beyond it; `CIRCUMFIX` on a prefix asks for a suffix with it, and the
  other way round; `ONLYINCOMPOUND` anywhere is no word; a rule strips a whole stem only with `FULLSTRIP`;
* a stem with `FORBIDDENWORD` has no forms, and its own form is no word, whatever else has it;
* case: a form stands for itself; without `KEEPCASE` a lower-case form also for its title form, and any form for its
  all-capital form; a lower-case word may also stand for its title or all-capital form. So `paris` and `PARIS`
  pass for Paris, `pARIS` does not.

Distinct words are asked once each; the rules are as many as the .aff file has and are broadcast, the stems only within
a counted bound. A word meets as many rows as rules add one of its ends, a few dozens, so work grows with
the distinct unknown words. Input conversions (`ICONV`) apply first. Null and empty words have no reading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .lexicon import AffixRules

#: Stems that may be broadcast.
BROADCAST = 1_000_000
RULE = "struct<flag:string,crosses:boolean,strip:string,adds:string,condition:string,more:array<string>>"


@dataclass(frozen=True)
class Affixed:
    """A dictionary: its rules, and its stems as (stem, key, flags), one row a line."""

    dictionary: str
    rules: AffixRules
    stems: DataFrame


def stem_rows(lines: DataFrame, rules: AffixRules) -> DataFrame:
    """Lines `word[/flags]`, with more after white space, as (stem, key, flags)."""
    entry = F.regexp_extract("value", r"^\s*(\S+(?: [^\s/]+)*)", 1)
    text = F.regexp_extract("value", r"/(\S*)", 1)
    if rules.flag_kind == "num":
        flags = F.split(text, ",")
    elif rules.flag_kind == "long":
        flags = F.regexp_extract_all(text, F.lit("(..)"), 1)
    else:
        flags = F.split(text, "")
    stem = F.substring_index(entry, "/", 1)
    rows = lines.select(stem.alias("stem"), F.array_distinct(F.filter(flags, lambda f: f != "")).alias("flags"))
    return rows.where("stem <> ''").select("stem", X.fold_key(F.col("stem")).alias("key"), "flags")


def read_stems(lines: DataFrame, rules: AffixRules, dictionary: str) -> Affixed:
    return Affixed(dictionary, rules, stem_rows(lines, rules))


def fold(word: str) -> str:
    """`functions.text.fold_key` of a driver's string."""
    return word.lower().replace("ς", "σ").replace("ß", "ss")


def _rule_rows(spark: SparkSession, rules: AffixRules, suffixes: bool, only: set[str] | None = None) -> tuple[DataFrame, list[int]]:
    """(cut, back, rule) and the lengths that `cut`, the folded end that a rule adds, may have."""
    rows = [
        (fold(add), fold(strip), (flag, cross, strip, add, condition.pattern, rules.flags(more)))
        for flag, (cross, entries) in (rules.suffixes if suffixes else rules.prefixes).items()
        if only is None or flag in only
        for strip, add, condition, more in entries
    ]
    return F.broadcast(spark.createDataFrame(rows, f"cut string, back string, rule {RULE}")), sorted({len(r[0]) for r in rows})


def _stripped(rows: DataFrame, rules: DataFrame, sizes: list[int], into: str, suffixes: bool, full: bool) -> DataFrame:
    """rows whose `rest` lost an affix and has back what the rule, now in `into`, had stripped."""
    if not sizes:
        return rows.limit(0)
    n = F.char_length("rest")
    ends = rows.withColumn("_n", F.explode(F.array(*[F.lit(k) for k in sizes]))).where(n >= F.col("_n") if full else n > F.col("_n"))
    at = n - F.col("_n")
    ends = ends.withColumn("cut", F.substr("rest", at + 1, F.col("_n")) if suffixes else F.substr("rest", F.lit(1), F.col("_n")))
    left = F.concat(F.substr("rest", F.lit(1), at), F.col("back")) if suffixes else F.concat(F.col("back"), F.substr("rest", F.col("_n") + 1, n))
    met = ends.join(rules, "cut")
    return met.select(*[c for c in rows.columns if c not in ("rest", into)], left.alias("rest"), F.col("rule").alias(into)).select(*rows.columns)


def _applied(form: Column, rule: Column, suffixes: bool = True) -> Column:
    n, cut = F.char_length(form), F.char_length(rule["strip"])
    made = F.concat(F.substr(form, F.lit(1), n - cut), rule["adds"]) if suffixes else F.concat(rule["adds"], F.substr(form, cut + 1, n))
    return F.when(rule.isNull(), form).otherwise(made)


def _fits(form: Column, rule: Column, suffixes: bool = True) -> Column:
    there = F.endswith(form, rule["strip"]) if suffixes else F.startswith(form, rule["strip"])
    return rule.isNull() | (there & F.regexp_like(form, rule["condition"]))


def stands_for(word: Column, form: Column, keep: Column) -> Column:
    """Whether a word may be written for a form of equal fold key."""
    small, capital = ~word.rlike(r"[\p{Lu}\p{Lt}]"), ~word.rlike(r"\p{Ll}")
    first, rest = F.substr(word, F.lit(1), F.lit(1)), F.substr(word, F.lit(2), F.char_length(word))
    title = word.rlike(r"^[\p{Lu}\p{Lt}]") & ~rest.rlike(r"[\p{Lu}\p{Lt}]")
    whole = F.lower(form) == F.lower(word)
    return (
        (word == form)
        | (~keep & ((title & (F.lower(word) == form)) | (capital & whole)))
        | (small & ((F.concat(F.upper(first), rest) == form) | (F.upper(word) == form) | (~keep & whole)))
    )


def readings(words: DataFrame, known: Affixed) -> DataFrame:
    """(word) -> (word, stem, prefix, suffix, second, form), the flags of the rules that make the form; several rows where words have several readings."""
    spark, rules = words.sparkSession, known.rules
    said = F.col("word")
    for given, read in rules.conversions:
        said = F.replace(said, F.lit(given), F.lit(read))
    asked = words.select("word").where("word <> ''").distinct().withColumn("said", said).withColumn("rest", X.fold_key(F.col("said")))
    none = F.lit(None).cast(RULE)
    whole = asked.withColumns({"suffix": none, "second": none, "prefix": none})
    suffixes, sizes = _rule_rows(spark, rules, True)
    carried = {f for _, entries in rules.suffixes.values() for *_, more in entries for f in rules.flags(more)}
    outer, outer_sizes = _rule_rows(spark, rules, True, carried & set(rules.suffixes))
    once = _stripped(whole, suffixes, sizes, "suffix", True, rules.full_strip)
    twice = _stripped(_stripped(whole, outer, outer_sizes, "second", True, rules.full_strip), suffixes, sizes, "suffix", True, rules.full_strip)
    twice = twice.where(F.array_contains("suffix.more", F.col("second.flag")))
    ends = whole.unionByName(once).unionByName(twice)
    prefixes, heads = _rule_rows(spark, rules, False)
    cut = ends.unionByName(_stripped(ends, prefixes, heads, "prefix", False, rules.full_strip))
    stems = known.stems.select("stem", F.col("key").alias("rest"), "flags")
    small = known.stems.limit(BROADCAST + 1).count() <= BROADCAST
    met = cut.join(F.broadcast(stems) if small else stems, "rest")

    p, s, t = F.col("prefix"), F.col("suffix"), F.col("second")
    has = lambda rule, flag: rule.isNotNull() & F.array_contains(rule["more"], flag)
    marked = lambda rule, flag: has(rule, F.lit(flag)) if flag else F.lit(False)
    own = lambda flag: F.array_contains("flags", flag)
    mark = lambda flag: own(F.lit(flag)) if flag else F.lit(False)
    prefix_own, suffix_own = own(p["flag"]), own(s["flag"])
    suffix_may = s.isNull() | suffix_own | (p.isNotNull() & prefix_own & has(p, s["flag"]))
    prefix_may = p.isNull() | prefix_own | (s.isNotNull() & suffix_own & (has(s, p["flag"]) | has(t, p["flag"])))
    cross = p.isNull() | s.isNull() | (p["crosses"] & s["crosses"] & (t.isNull() | t["crosses"]))
    need, inside, around = rules.need_affix, rules.only_in_compound, rules.circumfix
    needs = (
        (~mark(need) | s.isNotNull() | p.isNotNull()) & (~marked(s, need) | t.isNotNull() | p.isNotNull())
        & (~marked(t, need) | p.isNotNull()) & (~marked(p, need) | s.isNotNull())
    )
    alone = ~(mark(inside) | marked(s, inside) | marked(t, inside) | marked(p, inside))
    both = marked(p, around) == (marked(s, around) | marked(t, around))
    first = _applied(F.col("stem"), s)
    made = met.where(F.coalesce(suffix_may & prefix_may & cross & needs & alone & both & _fits(F.col("stem"), s), F.lit(False))).withColumn("first", first)
    made = made.where(_fits(F.col("first"), t)).withColumn("form", _applied(F.col("first"), t))
    made = made.where(_fits(F.col("form"), p, False)).withColumn("form", _applied(F.col("form"), p, False))
    made = made.where(stands_for(F.col("said"), F.col("form"), mark(rules.keep_case)))
    columns = ["word", "stem", p["flag"].alias("prefix"), s["flag"].alias("suffix"), t["flag"].alias("second"), "form"]
    if not rules.forbidden:
        return made.select(*columns)
    no = known.stems.where(mark(rules.forbidden)).select(F.col("stem").alias("form")).distinct()
    return made.where(~mark(rules.forbidden)).select(*columns).join(no, "form", "left_anti").select("word", "stem", "prefix", "suffix", "second", "form")


def accepted(words: DataFrame, known: Affixed) -> DataFrame:
    """The distinct words that have a reading."""
    return readings(words, known).select("word").distinct()


def closure(rules: AffixRules, stem: str, flags: list[str]) -> set[tuple[str, str | None, str | None, str | None]]:
    """All (form, prefix, suffix, second) of one stem by the rules of a reading, for a look at a dictionary entry."""

    def more(rule) -> list[str]:
        return rules.flags(rule[4]) if rule else []

    def all_of(table) -> list:
        return [None, *((flag, strip, add, condition, rest, cross) for flag, (cross, entries) in table.items() for strip, add, condition, rest in entries)]

    def put(form: str, rule, suffix: bool) -> str | None:
        if rule is None:
            return form
        _, strip, add, condition, _, _ = rule
        there = form.endswith(strip) if suffix else form.startswith(strip)
        if not there or not condition.search(form) or (len(form) == len(strip) and not rules.full_strip):
            return None
        return form[: len(form) - len(strip)] + add if suffix else add + form[len(strip) :]

    out = set()
    for s in all_of(rules.suffixes):
        first = put(stem, s, True)
        if first is None:
            continue
        for t in all_of(rules.suffixes) if s else [None]:
            if t and t[0] not in more(s):
                continue
            second = put(first, t, True)
            if second is None:
                continue
            for p in all_of(rules.prefixes):
                form = put(second, p, False)
                suffix_own, prefix_own = s and s[0] in flags, p and p[0] in flags
                linked = (not s or suffix_own or (prefix_own and s[0] in more(p))) and (not p or prefix_own or (suffix_own and p[0] in more(s) + more(t)))
                if form is None or not linked or (p and s and not (p[5] and s[5] and (not t or t[5]))):
                    continue
                used = [more(x) for x in (s, t, p)]
                need, around = rules.need_affix, rules.circumfix
                bare = need and ((need in flags and not s and not p) or (need in used[0] and not t and not p) or (need in used[1] and not p) or (need in used[2] and not s))
                inside = rules.only_in_compound and any(rules.only_in_compound in x for x in (flags, *used))
                half = around and (around in used[2]) != (around in used[0] + used[1])
                if not (bare or inside or half or (rules.forbidden and rules.forbidden in flags)):
                    out.add((form, p and p[0], s and s[0], t and t[0]))
    return out
