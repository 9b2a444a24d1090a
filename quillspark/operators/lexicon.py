"""Lexicons: relations of folded words that texts are checked against.

A lexicon is (dictionary, word, fold_key). Word lists are read by Spark; affix dictionaries are expanded
by `affixes` from their stems. Whether anything can be checked at all depends on a primary lexicon being there:
with none, results are empty rather than full of false findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def with_keys(words: DataFrame, dictionary: str) -> DataFrame:
    return words.select(F.lit(dictionary).alias("dictionary"), "word", X.fold_key(F.col("word")).alias("fold_key")).dropDuplicates(["fold_key", "word"])


def read_word_list(spark: SparkSession, path: str, dictionary: str) -> DataFrame:
    """One word a line as it is; blank lines and those that start with # are no words."""
    lines = spark.read.text(path).select(F.col("value").alias("word"))
    return with_keys(lines.where("word <> '' AND NOT startswith(word, '#')"), dictionary)


def from_words(spark: SparkSession, words: list[str], dictionary: str) -> DataFrame:
    return with_keys(spark.createDataFrame([(w,) for w in words], "word string"), dictionary)


def builtin(spark: SparkSession) -> DataFrame:
    """The list that ships with the engine: parts of the public names of Python, its standard modules and Spark's functions."""
    import builtins
    import keyword
    import re
    import sys

    names = {*keyword.kwlist, *keyword.softkwlist, *dir(builtins), *sys.stdlib_module_names, *dir(F)}
    words = {w.lower() for n in names for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", n) if len(w) > 1}
    return from_words(spark, sorted(words), "builtin")


def corpus_lexicon(rows: DataFrame, doc: str, least_docs: int, dictionary: str = "corpus") -> DataFrame:
    """Words that are in `least_docs` documents at least; counts are partial before the shuffle."""
    keyed = rows.select(F.col(doc).alias("_doc"), X.fold_key(F.col("word")).alias("fold_key")).distinct()
    return keyed.groupBy("fold_key").count().where(F.col("count") >= least_docs).select(F.lit(dictionary).alias("dictionary"), F.col("fold_key").alias("word"), "fold_key")


def text_lexicon(texts: DataFrame, text: str, least_docs: int, dictionary: str = "corpus") -> DataFrame:
    """As `corpus_lexicon`, from texts that are a document each: a text's words are made distinct in its row, so only counts are shuffled."""
    keys = F.array_distinct(F.transform(X.words(F.col(text)), X.fold_key))
    counts = texts.select(F.explode(keys).alias("fold_key")).groupBy("fold_key").count().where(F.col("count") >= least_docs)
    return counts.select(F.lit(dictionary).alias("dictionary"), F.col("fold_key").alias("word"), "fold_key")


def combined_list(lists: DataFrame) -> DataFrame:
    """The build of the built-in list: all lists' words, lowered, longer than a sign, once, in order."""
    return lists.select(F.lower("word").alias("word")).where(F.char_length("word") > 1).distinct().orderBy("word")


def common_words(texts: DataFrame, text: str) -> DataFrame:
    """Words of source texts: cut at all but letters and digits, only letters kept, lowered, longer than a sign."""
    parts = texts.select(F.explode(F.split(F.col(text), r"[_\W]")).alias("part"))
    return parts.select(F.lower(F.regexp_replace("part", "[^a-zA-Z]", "")).alias("word")).where(F.char_length("word") > 1).distinct().orderBy("word")


#: Commands that name a flag, switches, commands that are not applied, and the flags of parts of compounds with their places.
FLAG_NAMES = {"NEEDAFFIX": "need_affix", "PSEUDOROOT": "need_affix", "FORBIDDENWORD": "forbidden", "KEEPCASE": "keep_case", "CIRCUMFIX": "circumfix"}
SWITCHES = ("CHECKCOMPOUNDDUP", "CHECKCOMPOUNDCASE", "CHECKCOMPOUNDTRIPLE")
NOT_APPLIED = ("COMPLEXPREFIXES", "IGNORE", "CHECKSHARPS", "SIMPLIFIEDTRIPLE", "CHECKCOMPOUNDREP", "COMPOUNDFORBIDFLAG", "COMPOUNDROOT", "COMPOUNDSYLLABLE", "FORCEUCASE", "AF")
COMPOUND_FLAGS = {"COMPOUNDFLAG": "any", "COMPOUNDBEGIN": "first", "COMPOUNDMIDDLE": "inner", "COMPOUNDEND": "last", "COMPOUNDLAST": "last"}


@dataclass
class AffixRules:
    """Parsed .aff: flags to (strip, add, condition) by side, and the switches."""

    prefixes: dict[str, tuple[bool, list[tuple[str, str, re.Pattern, str]]]] = field(default_factory=dict)
    suffixes: dict[str, tuple[bool, list[tuple[str, str, re.Pattern, str]]]] = field(default_factory=dict)
    tries: str = ""
    replacements: list[tuple[str, str]] = field(default_factory=list)
    conversions: list[tuple[str, str]] = field(default_factory=list)
    compounds: list[str] = field(default_factory=list)
    compound_min: int = 3
    only_in_compound: str = ""
    #: Flags of parts of compounds by the place they may have: any, first, inner, last; and of affixes that may be inside.
    places: dict[str, str] = field(default_factory=dict)
    permit: str = ""
    no_suggest: str = ""
    flag_kind: str = "short"
    #: Flags of stems and affixes that `affix` heeds.
    need_affix: str = ""
    forbidden: str = ""
    keep_case: str = ""
    circumfix: str = ""
    full_strip: bool = False
    #: What compounds may not be: letters that may not meet as (end, its flag, beginning, its flag), and switches by name.
    meetings: list[tuple[str, str, str, str]] = field(default_factory=list)
    switches: set[str] = field(default_factory=set)
    most_parts: int = 0
    related: list[list[str]] = field(default_factory=list)
    #: Commands that change which words are right and are not applied.
    unapplied: list[str] = field(default_factory=list)

    def flags(self, text: str) -> list[str]:
        if self.flag_kind == "num":
            return [x for x in text.split(",") if x]
        return [text[k : k + 2] for k in range(0, len(text), 2)] if self.flag_kind == "long" else list(text)


def parse_affixes(text: str) -> AffixRules:
    """The commands of an .aff file; `unapplied` names those that would change which words are right and are not heeded."""
    rules = AffixRules()
    for raw in text.splitlines():
        words = raw.split("#")[0].split() if not raw.startswith(("PFX", "SFX", "REP", "ICONV", "TRY")) else raw.split()
        if not words:
            continue
        name, args = words[0], words[1:]
        if name in ("PFX", "SFX"):
            table = rules.prefixes if name == "PFX" else rules.suffixes
            if args[0] not in table:
                if len(args) < 3 or args[1] not in "YN":
                    raise ValueError(f"a rule without its head: {raw}")
                table[args[0]] = (args[1] == "Y", [])
            elif len(args) >= 3:
                condition = args[3] if len(args) > 3 and not args[3].startswith("#") else "."
                strip, add = ("" if x == "0" else x for x in (args[1], args[2].split("/")[0]))
                more = args[2].partition("/")[2]
                body = condition.replace("-", "\\-")
                table[args[0]][1].append((strip, add, re.compile(f"^{body}" if name == "PFX" else f"{body}$"), more))
        elif name == "TRY":
            rules.tries = args[0]
        elif name == "FLAG":
            rules.flag_kind = args[0]
        elif name in ("REP", "ICONV") and len(args) == 2:
            (rules.replacements if name == "REP" else rules.conversions).append((args[0], args[1].replace("_", " ")))
        elif name == "COMPOUNDRULE" and not args[0].isdigit():
            rules.compounds.append(args[0])
        elif name == "COMPOUNDMIN":
            rules.compound_min = int(args[0])
        elif name in COMPOUND_FLAGS:
            rules.places[args[0]] = COMPOUND_FLAGS[name]
        elif name == "COMPOUNDPERMITFLAG":
            rules.permit = args[0]
        elif name == "ONLYINCOMPOUND":
            rules.only_in_compound = args[0]
        elif name == "NOSUGGEST":
            rules.no_suggest = args[0]
        elif name in FLAG_NAMES:
            setattr(rules, FLAG_NAMES[name], args[0])
        elif name == "FULLSTRIP":
            rules.full_strip = True
        elif name in SWITCHES:
            rules.switches.add(name)
        elif name == "COMPOUNDWORDMAX":
            rules.most_parts = int(args[0])
        elif name == "CHECKCOMPOUNDPATTERN" and len(args) == 2:
            (end, _, end_flag), (start, _, start_flag) = (x.partition("/") for x in args)
            rules.meetings.append((end, end_flag, start, start_flag))
        elif name == "CHECKCOMPOUNDPATTERN" and len(args) > 2:
            rules.unapplied.append("CHECKCOMPOUNDPATTERN with a replacement")
        elif name == "MAP" and not args[0].isdigit():
            rules.related.append([x.strip("()") for x in re.findall(r"\([^)]*\)|.", args[0])])
        elif name in NOT_APPLIED and name not in rules.unapplied:
            rules.unapplied.append(name)
    return rules


def expand(rules: AffixRules, stem: str, flags: list[str]) -> set[str]:
    """All forms of a stem: suffixes, prefixes, and both where both may cross."""
    plain = set() if rules.only_in_compound and rules.only_in_compound in flags else {stem}
    crossing = set(plain) or {stem}
    out = set(plain)
    for flag in flags:
        cross, entries = rules.suffixes.get(flag, (False, []))
        for strip, add, condition, more in entries:
            if stem.endswith(strip) and condition.search(stem):
                word = stem[: len(stem) - len(strip)] + add
                if rules.only_in_compound and rules.only_in_compound in rules.flags(more):
                    continue
                out.add(word)
                if cross:
                    crossing.add(word)
    for flag in flags:
        cross, entries = rules.prefixes.get(flag, (False, []))
        for strip, add, condition, more in entries:
            if rules.only_in_compound and rules.only_in_compound in rules.flags(more):
                continue
            for word in crossing if cross else ([stem] if plain else []):
                if word.startswith(strip) and condition.search(word):
                    out.add(add + word[len(strip) :])
    return out


def forms(rules: AffixRules, stem: str, flags: list[str]) -> dict[str, set[str]]:
    """Forms of a stem with the places (first, inner, last) they may have in compounds.

    A stem has the places of its flags, a prefixed form the first of them and a suffixed one the last, and the others too
    where the affix is permitted inside; flags of the affix itself add theirs.
    """

    def places(own: list[str]) -> set[str]:
        found = {rules.places[x] for x in own if x in rules.places}
        return {"first", "inner", "last"} if "any" in found else found

    base = places(flags)
    out = {stem: set(base)}
    for table, edge in ((rules.suffixes, "last"), (rules.prefixes, "first")):
        for flag in flags:
            for strip, add, condition, more in table.get(flag, (False, []))[1]:
                own = rules.flags(more)
                if (stem.endswith(strip) if edge == "last" else stem.startswith(strip)) and condition.search(stem):
                    word = stem[: len(stem) - len(strip)] + add if edge == "last" else add + stem[len(strip) :]
                    may = base if rules.permit and rules.permit in own else base & {edge}
                    out.setdefault(word, set()).update(may | places(own))
    return out


def compound_forms(rules: AffixRules) -> list[str]:
    return [f"^(?:{r})$" for r in rules.compounds]


def affixes(stems: DataFrame, rules: AffixRules, dictionary: str) -> DataFrame:
    """Lines `word[/flags]` -> lexicon with `suggested`, false for words that are never suggested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, suggested = [], []
            for line in batch.column(0).to_pylist():
                stem, _, flags = line.split("\t")[0].strip().partition("/")
                own = rules.flags(flags.strip())
                for word in sorted(expand(rules, stem, own)) if stem else []:
                    words.append(word)
                    suggested.append(not (rules.no_suggest and rules.no_suggest in own))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(suggested, pa.bool_())], names=["word", "suggested"])

    rows = stems.select("value").mapInArrow(run, "word string, suggested boolean")
    # Case rules: a lower-case word also stands for its title and all-capital forms, which folding gives.
    return rows.select(F.lit(dictionary).alias("dictionary"), "word", X.fold_key(F.col("word")).alias("fold_key"), "suggested").groupBy("dictionary", "word", "fold_key").agg(F.max("suggested").alias("suggested"))


def read_pair(spark: SparkSession, aff: str, dic: str) -> tuple[AffixRules, DataFrame]:
    """The rules of an .aff file and the lines of its .dic file, whose first line is a count."""
    text = "\n".join(r["value"] for r in spark.read.text(aff).toLocalIterator())
    lines = spark.read.text(dic).where("trim(value) <> '' AND NOT value RLIKE '^[0-9]+\\\\s*$' AND NOT startswith(value, '#')")
    return parse_affixes(text.removeprefix("\ufeff")), lines


def read_affix_dictionary(spark: SparkSession, aff: str, dic: str, dictionary: str) -> DataFrame:
    """The words of an .aff and .dic pair, without compounds (`compounds.parts` has their parts)."""
    rules, lines = read_pair(spark, aff, dic)
    return affixes(lines, rules, dictionary)


def local_pair(folder: str, dictionary: str) -> tuple[str, str] | None:
    """The .aff and .dic files of a dictionary; None if one is missing, or if there is a word list, which goes first."""
    base = Path(folder) / dictionary
    pair = base.with_suffix(".aff"), base.with_suffix(".dic")
    if base.with_suffix(".txt").is_file() or not all(x.is_file() for x in pair):
        return None
    return tuple(f"file://{x.resolve()}" for x in pair)


def local_dictionary(spark: SparkSession, folder: str, dictionary: str) -> DataFrame | None:
    """`<id>.txt`, else the pair `<id>.aff` and `<id>.dic`; None if neither is there."""
    base = Path(folder) / dictionary
    if base.with_suffix(".txt").is_file():
        return read_word_list(spark, f"file://{base.with_suffix('.txt').resolve()}", dictionary)
    pair = local_pair(folder, dictionary)
    return read_affix_dictionary(spark, *pair, dictionary) if pair else None


def has_primary(lexicon: DataFrame | None) -> bool:
    return lexicon is not None and not lexicon.isEmpty()
