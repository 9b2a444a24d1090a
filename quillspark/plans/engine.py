"""The whole check as one plan: documents -> findings."""

from __future__ import annotations

import collections
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import affix, capture, check, compounds, lexicon, ranges, report, suggest, tokens
from ..schema import FINDING
from ..sources import files
from ..sources.stage import staged
from . import registry
from .policy import Policy, Settings, path_matches


class Memo:
    """The last answers by word, MOST of them; empty ones are not kept, as a dictionary may come."""

    MOST = 10_000

    def __init__(self) -> None:
        self.held: collections.OrderedDict[str, list[str]] = collections.OrderedDict()

    def __contains__(self, word: str) -> bool:
        return word in self.held

    def get(self, word: str) -> list[str] | None:
        if word in self.held:
            self.held.move_to_end(word)
        return self.held.get(word)

    def put(self, word: str, answer: list[str]) -> None:
        if answer:
            self.held[word] = answer
            self.held.move_to_end(word)
            while len(self.held) > self.MOST:
                self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()


class Engine:
    """Settings and lexicons, applied to tables of documents.

    A lexicon is any relation (dictionary, word, fold_key); `add_lexicon` registers one. Without a primary
    lexicon (an affix dictionary, a local one, or one marked so) every result is empty. Affix dictionaries check words by
    stripping; their expanded lexicon only serves suggestions. With `embedded`, the list that ships
    with the engine serves as the dictionary `builtin`, which is never primary.
    """

    def __init__(self, spark: SparkSession, policy: Policy | Settings | None = None, local_dir: str | None = None, embedded: bool = False):
        self.spark, self.local_dir, self.embedded = spark, local_dir, embedded
        self.policy = policy if isinstance(policy, Policy) else None
        self._settings = policy if isinstance(policy, Settings) else Settings()
        self.lexicons: dict[str, DataFrame] = {}
        self.parts: dict[str, DataFrame] = {}
        self.affixed: dict[str, affix.Affixed] = {}
        self.primary: set[str] = set()
        self.missing: set[str] = set()
        self.epoch, self.memo = 0, Memo()

    @property
    def settings(self) -> Settings:
        return self.policy.snapshot if self.policy else self._settings

    def add_lexicon(self, name: str, words: DataFrame, primary: bool = False, epoch: int | None = None, parts: DataFrame | None = None, affixed: affix.Affixed | None = None) -> bool:
        """Register a lexicon; one that was made before the last `invalidate` (of an earlier epoch) is not taken.

        `parts` are those of compounds; with `affixed`, words are checked by its rules and not by `words`.
        """
        if epoch is not None and epoch != self.epoch:
            return False
        self.lexicons[name] = words
        self.parts.pop(name, None)
        if parts is not None:
            self.parts[name] = parts
        self.affixed.pop(name, None)
        if affixed is not None:
            self.affixed[name] = affixed
        self.missing.discard(name)
        self.memo.clear()
        if primary or registry.dictionary_kind(name) == "affix":
            self.primary.add(name)
        return True

    def load(self, name: str) -> DataFrame | None:
        """From memory, then the local folder, then what ships with the engine; what is not there is remembered as missing."""
        if name not in self.lexicons and name not in self.missing:
            found = lexicon.local_dictionary(self.spark, self.local_dir, name) if self.local_dir else None
            if found is None and self.embedded and name == "builtin":
                self.lexicons[name] = lexicon.builtin(self.spark)
            elif found is None:
                self.missing.add(name)
            else:
                pair = lexicon.local_pair(self.local_dir, name)
                rules, lines = lexicon.read_pair(self.spark, *pair) if pair else (None, None)
                known = affix.read_stems(lines, rules, name) if pair else None
                self.add_lexicon(name, found, primary=True, parts=compounds.local_parts(self.spark, self.local_dir, name), affixed=known)
        return self.lexicons.get(name)

    def ensure(self, name: str) -> str:
        """unavailable, fresh or new."""
        had = name in self.lexicons
        self.missing.discard(name)
        return "unavailable" if self.load(name) is None else "fresh" if had else "new"

    def invalidate(self, name: str) -> None:
        if found := self.lexicons.pop(name, None):
            found.unpersist()
        self.parts.pop(name, None)
        self.affixed.pop(name, None)
        self.missing.clear()
        self.memo.clear()
        self.epoch += 1

    def wanted(self) -> list[str]:
        """All ids that any path or language may ask for."""
        languages = [d for x in registry.LANGUAGES for d in x.dictionaries if registry.dictionary_kind(d)]
        return sorted({*self.settings.all_dictionary_ids(), *registry.ALWAYS, *registry.LIST_IDS, *languages})

    def warm(self) -> dict[str, object]:
        states = {x: self.ensure(x) for x in self.wanted()}
        return {"available": self.has_primary(), "loaded": sorted(x for x, s in states.items() if s != "unavailable"), "missing": sorted(x for x, s in states.items() if s == "unavailable")}

    def has_primary(self) -> bool:
        return any(x in self.primary for x in self.lexicons)

    def _lexicon(self, ids: list[str]) -> DataFrame | None:
        out = None
        for name in ids:
            if (found := self.load(name)) is not None:
                part = found.select(F.lit(name).alias("dictionary"), "word", "fold_key")
                out = part if out is None else out.unionByName(part)
        return out

    def _parts(self, ids: list[str]) -> DataFrame | None:
        """Parts of compounds of those dictionaries that form any."""
        out = None
        for name in dict.fromkeys(ids):
            if name in self.parts:
                out = self.parts[name] if out is None else out.unionByName(self.parts[name])
        return out

    def _affixed(self, ids: list[str]) -> tuple[affix.Affixed, ...]:
        return tuple(self.affixed[x] for x in dict.fromkeys(ids) if x in self.affixed)

    def dictionary_ids(self, settings: Settings, languages: list[str]) -> list[str]:
        own = [d for x in registry.LANGUAGES if x.name in languages for d in x.dictionaries]
        extra = [x for x in self.lexicons if registry.dictionary_kind(x) is None]
        return sorted({*settings.dictionary_ids(), *registry.ALWAYS, *own, *extra})

    def regions(self, docs: DataFrame) -> DataFrame:
        """docs with language, skip ranges and checked regions; paths that are ignored or not included go."""
        s = self.settings
        df = files.with_language(docs)
        if s.ignore_paths:
            df = df.where(F.col("path").isNull() | ~path_matches(F.col("path"), s.ignore_paths))
        if s.include_paths:
            df = df.where(F.col("path").isNull() | path_matches(F.col("path"), s.include_paths))
        df = df.withColumn("skip", ranges.skip_ranges(F.col("text"), user=s.ignore_patterns))
        df = df.withColumn("area", capture.region_array(F.col("text"), F.col("language")))
        return df.withColumn("languages", capture.languages_of(F.col("area"), F.col("language"))).withColumn("area", capture.kept(F.col("area"), list(s.include_tags), list(s.exclude_tags)))

    def words(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        spans = F.array_distinct(F.transform("area", lambda r: F.struct(r["start_byte"].alias("start_byte"), r["end_byte"].alias("end_byte"))))
        return tokens.token_rows(docs, "text", F.col("skip"), keep, spans)

    def spell_check(self, docs: DataFrame) -> DataFrame:
        """(doc_id, path, language, text) -> (doc_id, word, locations)."""
        if docs.sparkSession is None or not self._gate():
            return self.spark.createDataFrame([], FINDING)
        s = self.settings
        if not s.overrides:
            return self._checked(docs, s)
        # Paths with the same overrides are checked together: as many plans as there are combinations.
        which = F.concat(*[F.when(path_matches(F.coalesce("path", F.lit("")), o.paths), "1").otherwise("0") for o in s.overrides])
        marked = docs.withColumn("_case", which)
        out = None
        for row in marked.select("_case").distinct().collect():
            own = s
            for hit, block in zip(row["_case"], s.overrides, strict=True):
                if hit == "1":
                    own = Settings(**{**own.__dict__, "overrides": (block.__class__(**{**block.__dict__, "paths": ("**",)}),)}).resolved("")
            part = self._checked(marked.where(F.col("_case") == row["_case"]).drop("_case"), Settings(**{**own.__dict__, "overrides": ()}))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], FINDING)

    def _gate(self) -> bool:
        for name in self.settings.all_dictionary_ids():
            self.load(name)
        return self.has_primary()

    def _checked(self, docs: DataFrame, s: Settings) -> DataFrame:
        held, self_settings = self._settings, self.policy
        self._settings, self.policy = s, None
        try:
            areas = self.regions(docs)
        finally:
            self._settings, self.policy = held, self_settings
        ids = self.dictionary_ids(s, [])
        base = self._lexicon([x for x in ids if x not in self.affixed])
        # Lexicons of a language count for documents that have it; all others for every document.
        rows = staged(self.words(areas, ["doc_id", "languages"]))  # segmentation runs once, whatever asks for words
        special = [(x.name, d) for x in registry.LANGUAGES for d in x.dictionaries if d in self.lexicons or self.load(d) is not None]
        german = [d for d in ids if d in registry.TRANSLITERATED and d in self.lexicons and d not in self.affixed]
        lex = base if base is not None else lexicon.from_words(self.spark, [], "none")
        bad = check.findings(rows.drop("languages"), lex, "doc_id", s.flag_words, s.words, s.min_length(), self._lexicon(german) if german else None, self._parts(ids), self._affixed(ids), registry.TRANSLITERATED)
        for name, d in special:
            own = self.lexicons[d].select("fold_key").distinct()
            has = rows.where(F.array_contains("languages", name)).select("doc_id").distinct()
            from ..functions import text as X

            known = bad.withColumn("fold_key", X.fold_key(F.col("word"))).join(own, "fold_key", "left_semi").join(has, "doc_id", "left_semi").where(~check.folded_in(F.col("fold_key"), s.flag_words)).select("doc_id", "word")
            bad = bad.join(known, ["doc_id", "word"], "left_anti")
        return bad

    def spell_check_text(self, text: str, language: str | None = None, path: str | None = None) -> DataFrame:
        return self.spell_check(files.one_text(self.spark, text, language, path)).drop("doc_id")

    def suggestions(self, words: DataFrame) -> DataFrame:
        """(word) -> (word, suggestions): base dictionaries only, whatever the paths or languages."""
        ids = [x for x in (*self.settings.dictionary_ids(), *registry.ALWAYS, *(n for n in self.lexicons if registry.dictionary_kind(n) is None)) if self.load(x) is not None]
        lex = self._lexicon(list(dict.fromkeys(ids)))
        if lex is None or not self.has_primary():
            return self.spark.createDataFrame([], "word string, suggestions array<string>")
        return suggest.suggestions(words, lex, list(dict.fromkeys(ids)), german=tuple(x for x in dict.fromkeys(ids) if x in registry.TRANSLITERATED), parts=self._parts(ids), affixed=self._affixed(ids), rules={x.dictionary: x.rules for x in self._affixed(ids)})

    def suggested(self, words: list[str]) -> dict[str, list[str]]:
        """Suggestions for a few words, as an editor asks for; those asked before come from memory."""
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            found = {r["word"]: list(r["suggestions"]) for r in self.suggestions(self.spark.createDataFrame([(w,) for w in new], "word string")).collect()}
            for w, xs in found.items():
                self.memo.put(w, xs)
        else:
            found = {}
        return {w: found.get(w) or self.memo.get(w) or [] for w in words}

    def lint(self, patterns: list[str], root: str | Path = ".", unique: bool = False, suggesting: bool = False) -> tuple[DataFrame, DataFrame]:
        """(report lines, summary row) of files."""
        root = Path(root).resolve()
        paths, failed = files.resolve_paths(patterns, root)
        if not paths:
            docs = self.spark.createDataFrame([], "doc_id long, path string, text string, state string, language string")
        else:
            docs = files.admitted(files.read_files(self.spark, paths, str(root)), self.settings).withColumn("doc_id", F.xxhash64("path")).withColumn("language", F.lit(None).cast("string"))
        good = docs.where("state = 'checked' AND text IS NOT NULL").select("doc_id", "path", "language", "text")
        places = report.placed(self.spell_check(good), good, "doc_id").drop("doc_id")
        if unique:
            places = report.first_only(places)
        hints = self.suggestions(places.select("word")) if suggesting else None
        state = docs.select("path", "state")
        summary = report.summary(state, places)
        if failed:
            summary = summary.withColumn("failure", F.lit(True)).withColumn("status", F.lit(2))
        return report.lines(places, suggestions=hints), summary


def sizes(column: Column) -> Column:
    return F.size(column).cast("long")
