"""Registered queries of the spell-analytics engine, each over its whole tables, and their SQL.

The lexicon is the corpus's own: folded words in `LEAST_DOCS` documents or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_settings, queries_words
from .functions import text as X
from .functions.variants import german_variants
from .operators import capture, check, lexicon, ranges, report, suggest, tokens
from .plans import registry
from .plans.engine import Engine
from .plans.policy import Override, Settings, resolved_lists
from .sources import files
from .sources.stage import staged
from .sql import LINE_COL, candidates, html_regions, skipped
from .streaming import sessions

LEAST_DOCS = 6
TOP = 100
FLAGGED, ALLOWED = ("the", "Und", "ESTE"), ("elle", "nicht")
#: The scopes that the policy queries use.
POLICY = Settings(
    words=("base",), flag_words=("never",), ignore_paths=("src1*", "**/none"), include_paths=("src?", "src2*/**", "src[3-5]*"),
    overrides=(Override(("src0",), words=("a", "b"), extra_words=("c",)), Override(("src*",), extra_flag_words=("x",), extra_words=("d",)), Override(("src2",), flag_words=(), dictionaries=("de",))),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_words(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*dict.fromkeys((*keep, "text")))
    return tokens.word_rows(files.spread(docs), "text", list(keep))


def ids_once(docs: DataFrame) -> bool:
    """Whether each document is one row, so that what is distinct in a row is distinct in a document."""
    return docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, word, n, d): n sums up to a word's occurrences, d to the documents with it.

    Where ids are not repeated, each text gives a row for each word, and one more for each distinct word, so no document's words are
    shuffled; else they are grouped and staged.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    if not ids_once(docs):
        return staged(doc_words(spark, sf_dir).groupBy("doc_id", "lang", "word").agg(F.count("*").alias("n"))).withColumn("d", F.lit(1).cast("long"))
    rows = lambda words, n: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(n).cast("long").alias("n"), F.lit(1 - n).cast("long").alias("d")))
    cut = files.spread(docs).select("doc_id", "lang", X.words(F.col("text")).alias("w"))
    return cut.select("doc_id", "lang", F.inline(F.concat(rows(F.col("w"), 1), rows(F.array_distinct("w"), 0))))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if not ids_once(docs):
        return staged(lexicon.corpus_lexicon(doc_words(spark, sf_dir), "doc_id", LEAST_DOCS))
    return staged(lexicon.text_lexicon(files.spread(docs), "text", LEAST_DOCS))


def token_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = doc_words(spark, sf_dir).where(X.has_letter(F.col("word")) & ~X.has_number(F.col("word")))
    return w.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("word").alias("n_words"), F.sum(F.char_length("word").cast("long")).alias("n_chars"))


def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = doc_counts(spark, sf_dir)
    return check.counted(counts, corpus(spark, sf_dir), ["lang"])


def unknown_words_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(unknown_words(spark, sf_dir), ["lang"], "n_occurrences", TOP).withColumn("rank", F.col("rank").cast("long"))


def findings_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = doc_counts(spark, sf_dir)
    bad = per_doc.where(F.char_length("word") >= 3).withColumn("fold_key", X.fold_key(F.col("word")))
    bad = bad.join(check.sized(corpus(spark, sf_dir).select("fold_key").distinct()), "fold_key", "left_anti")
    counts = bad.groupBy("doc_id").agg(F.sum("d").alias("n_words"), F.sum("n").alias("n_places"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_places", F.lit(0)).cast("long").alias("n_places"))


def flag_words_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = doc_counts(spark, sf_dir)
    return check.counted(counts, corpus(spark, sf_dir), ["lang"], FLAGGED, ALLOWED, min_length=4)


def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (("customer", "c_name"), ("nation", "n_name"), ("orders", "o_orderpriority"), ("part", "p_brand"), ("part", "p_name"), ("supplier", "s_name"))
    out = None
    for name, column in columns:
        rows = tokens.identifier_rows(table(spark, sf_dir, name).select(F.col(column).alias("x")), "x", []).groupBy("part").count().select(F.lit(column).alias("source"), "part", F.col("count").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def skip_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({ranges.DEFAULT_SKIP[2]})"), 1)).alias("hit"))
    return hits.groupBy("doc_id", "hit").agg(F.count("*").alias("n"))


def skip_ranges_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn("skip", ranges.skip_ranges(F.col("text")))
    return docs.select("doc_id", F.inline("skip")).select("doc_id", "start_byte", "end_byte")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("start_byte"), (F.col("l_partkey") % 200 + F.col("l_quantity").cast("long")).alias("end_byte"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.islands(_intervals(spark, sf_dir), ["l_orderkey"], "start_byte", "end_byte")


def interval_merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by arrays in the row, as documents carry their skip ranges."""
    lists = _intervals(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct("start_byte", "end_byte")).alias("r"))
    return lists.select("l_orderkey", F.inline(ranges.merged(F.col("r"))))


def containment_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 200).alias("start_byte"), (F.col("l_suppkey") % 200 + 5).alias("end_byte"))
    return ranges.outside_join(items, _intervals(spark, sf_dir), "l_orderkey")


def first_occurrence_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), "text")
    first = report.first_words(docs.select("path", X.words(F.col("text")).alias("words")), 3)
    return first.select("path", F.col("start_byte").cast("long").alias("place"), "word")


def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.admitted(table(spark, sf_dir, "documents").select(F.col("source").alias("path"), "doc_id"), POLICY)
    bad = findings_per_document(spark, sf_dir).where("n_places > 0")
    errors = docs.where("state = 'checked'").join(bad, "doc_id").select("path")
    return report.summary(docs, errors).select("total", "checked", "ignored", "excluded", "errors", "files_with_errors", F.col("status").cast("long").alias("status"))


def language_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat_ws(".", "url", F.element_at(F.array(*[F.lit(x) for x in ("rs", "py", "md", "Justfile", "R", "PY", "c", "htm")]), (F.col("page_id") % 8 + 1).cast("int"))).alias("path"))
    return pages.select("page_id", registry.of_path(F.col("path")).alias("language"), registry.path_key(F.col("url")).alias("url_key"))


def override_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = resolved_lists(table(spark, sf_dir, "documents").select(F.col("source").alias("path")), POLICY)
    return lists.select("path", *[F.array_join(n, ",").alias(n) for n in ("dictionaries", "words", "flag_words")])


def dictionary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dictionaries_for(language_of_path(spark, sf_dir).select("page_id", "language"), ("en_us", "de"))


def html_text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), F.lit("HTML").alias("language")))
    return capture.region_rows(pages, ["page_id"])


def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = html_text_regions(spark, sf_dir)
    return areas.where(X.tag_checked(F.col("tag"), ["string", "comment"], ["comment.line"])).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"))


def findings_with_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges, lines and columns of the words of documents that no lexicon has."""
    docs = files.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn("skip", ranges.skip_ranges(F.col("text")))
    rows = tokens.token_rows(docs, "text", F.col("skip"), ["doc_id"])
    bad = check.findings(staged(rows), corpus(spark, sf_dir))
    return report.placed(bad, docs, "doc_id", ("source",))


def plain_settings() -> Settings:
    return Settings(
        words=("Elle", "NICHT"), flag_words=("und", "Ered"), ignore_paths=("src1*/**",), include_paths=("src?/**", "none/*", "src[2-4]*/*"), ignore_patterns=("^Le[^ ]*", "[a-z]+eau[a-z]*"), min_word_length=4,
        overrides=(Override(("src0/**",), extra_words=("ouen", "the"), flag_words=("die",)), Override(("src?/*",), extra_flag_words=("Ouen",), ignore_patterns=("mit [a-z]+",)), Override(("none/**",), extra_ignore_patterns=("des[a-z]*",))),
    )


def engine_text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine over all documents as plain-text files, with all settings that depend on a path."""
    engine = Engine(spark, plain_settings())
    engine.add_lexicon("corpus", corpus(spark, sf_dir), primary=True)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.lit(None).cast("string").alias("language"), "text")
    found = engine.spell_check(files.spread(docs))
    return found.select("doc_id", "word", F.inline("locations"))


def html_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the checked regions of pages."""
    pages = files.spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))
    pages = pages.withColumn("skip", ranges.skip_ranges(F.col("text"))).withColumn("area", capture.region_array(F.col("text"), F.lit("HTML")))
    spans = F.transform("area", lambda r: F.struct(r["start_byte"].alias("start_byte"), r["end_byte"].alias("end_byte")))
    rows = staged(tokens.token_rows(pages, "text", F.col("skip"), ["page_id"], spans).distinct())
    return check.findings(rows, corpus(spark, sf_dir), "page_id").select("page_id", "word", F.size("locations").cast("long").alias("n"))


def german_variant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = doc_words(spark, sf_dir).where("lang = 'de'").select("word").distinct()
    return w.select("word", F.posexplode(german_variants(F.col("word"))).alias("mask", "variant")).select("word", (F.col("mask") + 1).cast("long").alias("mask"), "variant")


def german_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German words that the lexicon has neither as they are nor in a reading with umlauts."""
    counts = doc_counts(spark, sf_dir)
    lex = corpus(spark, sf_dir)
    asked = counts.where("lang = 'de'").select("word").distinct().withColumn("fold_key", X.fold_key(F.col("word")))
    return check.unknown(asked, lex, lex).select("word")


def suggest_within_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions within two edits for the unknown words of the benchmark."""
    asked = tokens.word_rows(table(spark, sf_dir, "benchmark"), "text", ["item_id"]).where(F.char_length("word") >= 3).select("word").distinct()
    lex = corpus(spark, sf_dir)
    asked = asked.withColumn("fold_key", X.fold_key(F.col("word"))).join(lex.select("fold_key"), "fold_key", "left_anti")
    return suggest.ranked(asked, lex).select("word", F.col("rank").cast("long").alias("rank"), "suggestion")


def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tokens.word_rows(table(spark, sf_dir, "benchmark"), "text", ["item_id"]).where(F.char_length("word") >= 3).select("word").distinct()
    lex = corpus(spark, sf_dir)
    asked = asked.withColumn("fold_key", X.fold_key(F.col("word"))).join(lex.select("fold_key"), "fold_key", "left_anti")
    return suggest.ranked(asked, lex, distance=1).select("word", F.col("rank").cast("long").alias("rank"), "suggestion")


def suggest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions within two edits for every unknown word of documents."""
    texts = files.spread(table(spark, sf_dir, "documents").select("text"))
    lex = staged(lexicon.text_lexicon(texts, "text", LEAST_DOCS))
    words = texts.select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("word")).where(F.char_length("word") >= 3).distinct()
    asked = words.withColumn("fold_key", X.fold_key(F.col("word"))).join(check.sized(lex.select("fold_key")), "fold_key", "left_anti")
    return suggest.ranked(staged(asked), lex).select("word", F.col("rank").cast("long").alias("rank"), "suggestion")


def line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("instr(text, 'est') > 0")
    at = F.octet_length(F.substring_index("text", "est", 1)).cast("long")
    return docs.select("doc_id", at.alias("start_byte"), X.line_col(F.col("text"), at).alias("p"), X.utf16_line_col(F.col("text"), at).alias("q")).select("doc_id", "start_byte", "p.line", "p.col", F.col("q.line").alias("line0"), F.col("q.col").alias("col16"))


def latest_turn_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    events = turns.select(F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("version"), F.col("role").alias("language_id"), F.when(F.col("turn") == 0, "open").otherwise("change").alias("op"), "text")
    return sessions.last_change(events).select("uri", "version", F.col("language_id").alias("role"), "text")


def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open documents after turns as edits: turn 0 opens, every seventh conversation is closed at its turn 3."""
    turns = table(spark, sf_dir, "conversations")
    op = F.when(F.col("turn") == 0, "open").when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 3), "close").otherwise("change")
    events = turns.select(F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("version"), F.col("role").alias("language_id"), op.alias("op"), "text", F.col("turn").alias("seq"))
    return sessions.current(events).select("uri", "version", "text")


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


def common_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.common_words(table(spark, sf_dir, "documents"), "text")


def word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = doc_words(spark, sf_dir)
    return w.groupBy("lang", X.word_case(F.col("word")).alias("case")).agg(F.count("*").alias("n"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-off, environment flags, severities, HTTP dates and cache names over the events."""
    e = table(spark, sf_dir, "events")
    flag = F.element_at(F.array(F.lit("0"), F.lit("False"), F.lit(""), F.lit("yes"), F.lit("1")), (F.col("event_id") % 5 + 1).cast("int"))
    level = F.element_at(F.array(F.lit("Error"), F.lit("warning"), F.lit("HINT"), F.lit("else")), (F.col("event_id") % 4 + 1).cast("int"))
    sent = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return e.select("event_id", X.back_off(F.col("event_id") % 12).alias("wait"), X.env_flag(flag).alias("flag"), X.severity(level).cast("long").alias("severity"), F.unix_timestamp(X.http_date(sent)).alias("epoch"), X.cache_name(F.col("event_type")).alias("file"))


def text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 slices, lines by number and cuts by bytes."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", X.utf16_slice(F.col("text"), F.lit(3), F.lit(40)).alias("slice"), X.nth_line(F.col("text"), F.col("doc_id") % 3).alias("line"), X.at_bytes(F.col("text"), F.lit(0), F.octet_length(F.substring_index("text", " ", 2)).cast("long")).alias("head"))


def suggestions_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions from two lexicons in turns: words of many documents, and words of the benchmark."""
    frequent = corpus(spark, sf_dir)
    items = lexicon.with_keys(tokens.word_rows(table(spark, sf_dir, "benchmark"), "text", []).select(F.lower("word").alias("word")).distinct(), "items")
    asked = tokens.word_rows(table(spark, sf_dir, "conversations"), "text", []).where(F.char_length("word") >= 5).distinct()
    hints = suggest.suggestions(asked, frequent.unionByName(items), ["corpus", "items"])
    return hints.select("word", F.array_join("suggestions", ",").alias("suggestions"))


def engine_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check with path settings: documents as files of several languages, an override for one source."""
    settings = Settings(ignore_paths=("src19/**",), flag_words=("never",), min_word_length=4, overrides=(Override(("src0/**",), extra_words=("ouen", "thandere")),))
    engine = Engine(spark, settings)
    engine.add_lexicon("corpus", corpus(spark, sf_dir), primary=True)
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("txt", "md", "py", "html")]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), F.lit(None).cast("string").alias("language"), "text")
    return engine.spell_check(files.spread(docs))


def diagnostics_and_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's findings in editor coordinates, with replacements."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    rows = tokens.token_rows(items.withColumn("skip", ranges.skip_ranges(F.col("text"))), "text", F.col("skip"), ["doc_id"])
    lex = corpus(spark, sf_dir)
    bad = check.findings(rows, lex)
    hints = suggest.suggestions(bad.select("word"), lex, ["corpus"])
    return report.quick_fixes(report.diagnostics(bad, items, "doc_id", "warning"), hints)


QUERIES = {f.__name__: f for f in (
    unknown_words_topk, token_counts_by_lang, unknown_words, findings_per_document, flag_words_override, identifier_split, skip_pattern_hits, skip_ranges_merged, interval_merge, interval_merge_arrays,
    containment_anti_join, first_occurrence_unique, lint_summary, language_of_path, override_resolution, dictionary_sets, html_text_regions, tag_filter, findings_with_ranges, html_findings,
    german_variant_words, suggest_topk, suggest_documents, line_col, latest_turn_state, session_documents, content_hash_dedup, common_word_list, word_cases,
    scalar_functions, text_slices, suggestions_round_robin, engine_findings, diagnostics_and_fixes, engine_text_findings, german_unknown, suggest_within_two,
)}

_KEY = "replace(replace(lower({0}), 'ς', 'σ'), 'ß', 'ss')"
_WORDS = rf"""
words AS (
  SELECT doc_id, lang, source, unnest(regexp_extract_all(coalesce(text, ''), '{X.WORD_PATTERN.replace("'", "''")}')) AS word FROM documents
), lex AS (
  SELECT k AS fold_key FROM (SELECT DISTINCT doc_id, {_KEY.format('word')} AS k FROM words) GROUP BY k HAVING count(*) >= {LEAST_DOCS}
)"""
_UNKNOWN = f"""
SELECT lang, word, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occurrences FROM words
WHERE length(word) >= 3 AND {_KEY.format('word')} NOT IN (SELECT fold_key FROM lex) GROUP BY lang, word
"""
_PARTS = r"([^\p{Lu}0-9_.:])(\p{Lu})", r"(\p{Lu})(\p{Lu}[a-z])", r"([^0-9_.:])([0-9])", r"([0-9])([^0-9_.:])"


def _split(column: str) -> str:
    out = column
    for p in _PARTS:
        out = f"regexp_replace({out}, '{p}', '\\1_\\2', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '[_.:]+'), lambda x: x <> '')"


def _merged_sql(source: str) -> str:
    return f"""
SELECT l_orderkey, min(s) AS start_byte, max(e) AS end_byte FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN coalesce(s > max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM {source}))
GROUP BY l_orderkey, island
"""


_INTERVALS = "(SELECT l_orderkey, l_partkey % 200 AS s, l_partkey % 200 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"
_STATE = "CASE WHEN regexp_matches(source, '^src1') THEN 'ignored' WHEN NOT (regexp_matches(source, '^src.$') OR regexp_matches(source, '^src2.*/') OR regexp_matches(source, '^src[3-5]')) THEN 'excluded' ELSE 'checked' END"


_PAGE = "page AS (SELECT page_id AS owner, html AS text FROM pages)"
#: From words `w`: all readings of their pairs of letters, by mask.
_READINGS = r"""cut AS (SELECT word, string_split(regexp_replace(word, '(ae|Ae|AE|oe|Oe|OE|ue|Ue|UE|ss)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM w),
masked AS (SELECT word, p, unnest(range(1, CAST(pow(2, (len(p) - 1) // 2) AS BIGINT))) AS mask FROM cut WHERE (len(p) - 1) // 2 BETWEEN 1 AND 4),
reading AS (SELECT word, mask, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 AND (mask >> CAST(i // 2 - 1 AS BIGINT)) & 1 = 1
  THEN map {'ae': 'ä', 'Ae': 'Ä', 'AE': 'Ä', 'oe': 'ö', 'Oe': 'Ö', 'OE': 'Ö', 'ue': 'ü', 'Ue': 'Ü', 'UE': 'Ü', 'ss': 'ß'}[x] ELSE x END), '') AS variant FROM masked)""".replace("\\\\", "\\")


def _one_byte(word: str) -> str:
    """Letters with marks as signs that words do not have: the distance counts bytes."""
    return f"translate({word}, 'éèêëçàâîïôöûüùäñóíúá', '0123456789!@#$%&+=<>')"


def _engine_sql() -> str:
    """Each path's lists and patterns by hand: sources src0, other src?, and src2 to src4 of more digits or none."""
    docs = "docs AS (SELECT doc_id, coalesce(source, 'none') AS src, text FROM documents WHERE NOT starts_with(coalesce(source, 'none'), 'src1') AND regexp_matches(coalesce(source, 'none'), '^(src.|none|src[2-4].*)$'))"
    out = []
    base = ("^Le[^ ]*", "[a-z]+eau[a-z]*")
    for where, flags, allowed, patterns in (
        ("src = 'src0'", ("die", "ouen"), ("elle", "nicht", "ouen", "the"), ("mit [a-z]+",)),
        ("src <> 'src0' AND regexp_matches(src, '^src.$')", ("und", "ered", "ouen"), ("elle", "nicht"), ("mit [a-z]+",)),
        ("src = 'none'", ("und", "ered"), ("elle", "nicht"), (*base, "des[a-z]*")),
        ("regexp_matches(src, '^src..+$')", ("und", "ered"), ("elle", "nicht"), base),
    ):
        listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
        key = _KEY.format("word")
        out.append(f"""SELECT * FROM (WITH mine AS (SELECT doc_id, text FROM docs WHERE {where}), {candidates('mine', 'doc_id', patterns)}
SELECT doc_id, word, CAST(b AS BIGINT) AS start_byte, CAST(b + strlen(word) AS BIGINT) AS end_byte FROM candidate
WHERE {key} IN ({listed(flags)}) OR (length(word) >= 4 AND {key} NOT IN ({listed(allowed)}) AND {key} NOT IN (SELECT fold_key FROM lex)))""")
    return f"WITH {_WORDS}, {docs} " + " UNION ALL ".join(out)


SQL = {
    "token_counts_by_lang": f"WITH {_WORDS} SELECT lang, count(*) AS n_tokens, count(DISTINCT word) AS n_words, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM words GROUP BY lang",
    "unknown_words": f"WITH {_WORDS} {_UNKNOWN}",
    "unknown_words_topk": f"WITH {_WORDS}, u AS ({_UNKNOWN}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_occurrences DESC, word) AS rank FROM u) WHERE rank <= {TOP}",
    "findings_per_document": f"""WITH {_WORDS}, bad AS (SELECT doc_id, word, count(*) AS n FROM words WHERE length(word) >= 3 AND {_KEY.format('word')} NOT IN (SELECT fold_key FROM lex) GROUP BY doc_id, word)
SELECT d.doc_id, count(b.word) AS n_words, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_places FROM documents d LEFT JOIN bad b ON b.doc_id = d.doc_id GROUP BY d.doc_id""",
    "flag_words_override": f"""WITH {_WORDS}, k AS (SELECT *, {_KEY.format('word')} AS key FROM words)
SELECT lang, word, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occurrences FROM k
WHERE key IN ({', '.join(repr(x.lower()) for x in FLAGGED)}) OR (length(word) >= 4 AND key NOT IN ({', '.join(repr(x.lower()) for x in ALLOWED)}) AND key NOT IN (SELECT fold_key FROM lex)) GROUP BY lang, word""",
    "identifier_split": " UNION ALL ".join(
        f"SELECT '{c}' AS source, part, count(*) AS n FROM (SELECT unnest({_split(c)}) AS part FROM {t}) WHERE NOT regexp_matches(part, '\\p{{N}}') GROUP BY part"
        for t, c in (("customer", "c_name"), ("nation", "n_name"), ("orders", "o_orderpriority"), ("part", "p_brand"), ("part", "p_name"), ("supplier", "s_name"))
    ),
    "skip_pattern_hits": f"SELECT doc_id, hit, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{ranges.DEFAULT_SKIP[2]}')) AS hit FROM documents) GROUP BY doc_id, hit",
    "interval_merge": _merged_sql(_INTERVALS),
    "interval_merge_arrays": _merged_sql(_INTERVALS),
    "containment_anti_join": f"""SELECT l_orderkey, l_linenumber, s AS start_byte, e AS end_byte FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 200 AS s, l_suppkey % 200 + 5 AS e FROM lineitem) i
WHERE NOT EXISTS (SELECT 1 FROM {_INTERVALS} r WHERE r.l_orderkey = i.l_orderkey AND i.s >= r.s AND i.e <= r.e)""",
    "first_occurrence_unique": rf"""WITH w AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, regexp_extract_all(text, '{X.WORD_PATTERN.replace("'", "''")}') AS w FROM documents),
p AS (SELECT path, unnest(range(len(w))) AS place, unnest(w) AS word FROM w)
SELECT path, place, word FROM p WHERE length(word) >= 3 QUALIFY row_number() OVER (PARTITION BY lower(word) ORDER BY path, place) = 1""",
    "lint_summary": f"""WITH {_WORDS}, bad AS (SELECT DISTINCT doc_id FROM words WHERE length(word) >= 3 AND {_KEY.format('word')} NOT IN (SELECT fold_key FROM lex)),
s AS (SELECT doc_id, source, {_STATE} AS state FROM documents)
SELECT count(*) AS total, count(*) FILTER (state = 'checked') AS checked, count(*) FILTER (state = 'ignored') AS ignored, count(*) FILTER (state = 'excluded') AS excluded,
  count(*) FILTER (state = 'checked' AND doc_id IN (SELECT doc_id FROM bad)) AS errors, count(DISTINCT CASE WHEN state = 'checked' AND doc_id IN (SELECT doc_id FROM bad) THEN source END) AS files_with_errors,
  CAST(CASE WHEN count(*) FILTER (state = 'checked' AND doc_id IN (SELECT doc_id FROM bad)) > 0 THEN 1 ELSE 0 END AS BIGINT) AS status FROM s""",
    "language_of_path": r"""SELECT page_id, ['Rust', 'Python', 'Markdown', 'Just', 'R', 'Text', 'C', 'HTML'][page_id % 8 + 1] AS language,
  regexp_extract(regexp_extract(replace(url, '\', '/'), '[^/]*$'), '[^.]*$') AS url_key FROM pages""",
    "override_resolution": """SELECT source AS path, CASE WHEN source = 'src2' THEN 'de' ELSE '' END AS dictionaries,
  CASE WHEN source = 'src0' THEN 'a,b,c' ELSE 'base' END || CASE WHEN source LIKE 'src%' THEN ',d' ELSE '' END AS words,
  CASE WHEN source = 'src2' THEN '' WHEN source LIKE 'src%' THEN 'never,x' ELSE 'never' END AS flag_words FROM (SELECT DISTINCT source FROM documents)""",
    "dictionary_sets": """SELECT page_id, d AS dictionary, CASE WHEN d IN ('en_us', 'de') THEN 'affix' ELSE 'list' END AS kind, d = 'de' AS transliterated
FROM pages, (SELECT unnest(['en_us', 'de', 'builtin', 'software_terms', 'computing_acronyms']) AS d)
UNION ALL SELECT page_id, 'rust', 'list', false FROM pages WHERE page_id % 8 = 0""",
    "line_col": """WITH p AS (SELECT doc_id, text[1 : strpos(text, 'est') - 1] AS head FROM documents WHERE strpos(text, 'est') > 0),
q AS (SELECT doc_id, CAST(octet_length(encode(head)) AS BIGINT) AS start_byte, length(head) - length(replace(head, chr(10), '')) AS nl, regexp_extract(head, '[^\\n]*$') AS tail FROM p)
SELECT doc_id, start_byte, nl + 1 AS line, length(tail) + 1 AS col, nl AS line0, length(tail) AS col16 FROM q""".replace("\\\\n", "\\n"),
    "suggest_topk": rf"""WITH {_WORDS}, asked AS (
  SELECT DISTINCT word, {_KEY.format('word')} AS key FROM (SELECT unnest(regexp_extract_all(text, '{X.WORD_PATTERN.replace("'", "''")}')) AS word FROM benchmark) WHERE length(word) >= 3
), near AS (
  SELECT a.word, a.key, l.fold_key AS known FROM asked a JOIN lex l ON CASE length(a.key) - length(l.fold_key)
      WHEN 0 THEN len(list_filter(range(length(a.key)), lambda i: a.key[i + 1] <> l.fold_key[i + 1])) = 1
      WHEN 1 THEN len(list_filter(range(length(a.key)), lambda i: a.key[1 : i] || a.key[i + 2 :] = l.fold_key)) > 0
      WHEN -1 THEN len(list_filter(range(length(l.fold_key)), lambda i: l.fold_key[1 : i] || l.fold_key[i + 2 :] = a.key)) > 0
      ELSE false END
  WHERE a.key NOT IN (SELECT fold_key FROM lex)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY abs(length(key) - length(known)), known) AS rank FROM near
)
SELECT word, rank, CASE WHEN regexp_full_match(word, '\p{{Lu}}+') THEN translate(known, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE known END AS suggestion FROM ranked WHERE rank <= 5""",
    "scalar_functions": """SELECT event_id, CAST(least(30 * pow(2, least(event_id % 12, 7)), 3600) AS BIGINT) AS wait, event_id % 5 >= 3 AS flag, [1, 2, 4, 3][event_id % 4 + 1]::BIGINT AS severity,
  CAST(floor(epoch(ts)) AS BIGINT) AS epoch, sha256(event_type) AS file FROM events""",
    "text_slices": """SELECT doc_id, text[4 : 40] AS slice, string_split(text, chr(10))[doc_id % 3 + 1] AS line,
  CASE WHEN strpos(text, ' ') = 0 THEN text ELSE array_to_string(string_split(text, ' ')[1 : 2], ' ') END AS head FROM documents WHERE text IS NOT NULL""",
    "latest_turn_state": "SELECT CAST(conv_id AS VARCHAR) AS uri, turn AS version, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "session_documents": """SELECT CAST(conv_id AS VARCHAR) AS uri, turn AS version, text FROM conversations c
WHERE EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn = 0) AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND c.conv_id % 7 = 0 AND o.turn = 3)
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "content_hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1",
    "common_word_list": r"SELECT DISTINCT word FROM (SELECT lower(regexp_replace(unnest(string_split_regex(text, '[_\W]')), '[^a-zA-Z]', '', 'g')) AS word FROM documents) WHERE length(word) > 1",
    "word_cases": f"""WITH {_WORDS} SELECT lang, CASE WHEN regexp_matches(word, '^\\p{{Lu}}+$') THEN 'all_caps' WHEN regexp_matches(word, '^\\p{{Ll}}+$') THEN 'all_lower' WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 'title' ELSE 'unknown' END AS "case", count(*) AS n FROM words GROUP BY 1, 2""",
    "skip_ranges_merged": f"WITH {skipped('documents', 'doc_id')} SELECT doc_id, CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte FROM skip",
    "findings_with_ranges": f"""WITH {_WORDS}, {candidates('documents', 'doc_id')}
SELECT c.doc_id, d.source, word, CAST(b AS BIGINT) AS start_byte, CAST(b + strlen(word) AS BIGINT) AS end_byte, {LINE_COL} FROM candidate c JOIN documents d ON d.doc_id = c.doc_id
WHERE length(word) >= 3 AND {_KEY.format('word')} NOT IN (SELECT fold_key FROM lex)""",
    "engine_text_findings": _engine_sql(),
    "html_text_regions": f"WITH {_PAGE}, {html_regions()} SELECT owner AS page_id, tag, language, CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte FROM region",
    "tag_filter": f"""WITH {_PAGE}, {html_regions()} SELECT owner AS page_id, tag, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS bytes FROM region
WHERE tag = 'string' OR tag = 'comment' OR starts_with(tag, 'string.') OR (starts_with(tag, 'comment.') AND tag <> 'comment.line' AND NOT starts_with(tag, 'comment.line.')) GROUP BY 1, 2""",
    "html_findings": f"""WITH {_WORDS}, {_PAGE}, {html_regions()}, area AS (
  SELECT row_number() OVER () AS rid, owner, s AS base, decode(encode(text)[s + 1 : e]) AS text FROM (SELECT DISTINCT owner, s, e FROM region) JOIN page USING (owner)
), {candidates('area', 'rid', parts_of='page')}
SELECT owner AS page_id, word, count(DISTINCT base + b) AS n FROM candidate JOIN area USING (rid) WHERE length(word) >= 3 AND {_KEY.format('word')} NOT IN (SELECT fold_key FROM lex) GROUP BY 1, 2""",
    "suggestions_round_robin": rf"""WITH {_WORDS}, item AS (
  SELECT DISTINCT lower(w) AS suggestion FROM (SELECT unnest(regexp_extract_all(text, '{X.WORD_PATTERN.replace("'", "''")}')) AS w FROM benchmark)
), known AS (
  SELECT 0 AS source, fold_key AS suggestion, fold_key AS known FROM lex UNION SELECT 1, suggestion, {_KEY.format('suggestion')} FROM item
), asked AS (
  SELECT DISTINCT word, {_KEY.format('word')} AS key FROM (SELECT unnest(regexp_extract_all(text, '{X.WORD_PATTERN.replace("'", "''")}')) AS word FROM conversations) WHERE length(word) >= 5
), near AS (
  SELECT word, key, known.*, levenshtein({_one_byte('key')}, {_one_byte('known')}) AS d FROM asked JOIN known ON abs(length(key) - length(known)) <= 2
  WHERE key NOT IN (SELECT known FROM known) AND levenshtein({_one_byte('key')}, {_one_byte('known')}) <= 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word, source ORDER BY d, abs(length(key) - length(known)), suggestion) AS rank FROM near
), cased AS (
  SELECT word, source, rank, CASE WHEN regexp_full_match(word, '\p{{Lu}}+') THEN translate(suggestion, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE suggestion END AS item FROM ranked WHERE rank <= 5
), firsts AS (
  SELECT word, item, min((rank, source)) AS spot FROM cased GROUP BY 1, 2
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY spot, item) AS n FROM firsts
) SELECT word, string_agg(item, ',' ORDER BY n) AS suggestions FROM numbered WHERE n <= 5 GROUP BY word""",
    "german_unknown": f"""WITH {_WORDS}, w AS (SELECT DISTINCT word, {_KEY.format('word')} AS key FROM words WHERE lang = 'de'), {_READINGS}
SELECT word FROM w WHERE key NOT IN (SELECT fold_key FROM lex) AND word NOT IN (SELECT word FROM reading WHERE {_KEY.format('variant')} IN (SELECT fold_key FROM lex))""",
    "suggest_within_two": rf"""WITH {_WORDS}, asked AS (
  SELECT DISTINCT word, {_KEY.format('word')} AS key FROM (SELECT unnest(regexp_extract_all(text, '{X.WORD_PATTERN.replace("'", "''")}')) AS word FROM benchmark) WHERE length(word) >= 3
), near AS (
  SELECT a.word, a.key, l.fold_key AS known, levenshtein({_one_byte('a.key')}, {_one_byte('l.fold_key')}) AS d FROM asked a JOIN lex l ON abs(length(a.key) - length(l.fold_key)) <= 2
  WHERE a.key NOT IN (SELECT fold_key FROM lex) AND levenshtein({_one_byte('a.key')}, {_one_byte('l.fold_key')}) <= 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, abs(length(key) - length(known)), known) AS rank FROM near
)
SELECT word, rank, CASE WHEN regexp_full_match(word, '\p{{Lu}}+') THEN translate(known, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE known END AS suggestion FROM ranked WHERE rank <= 5""",
    "german_variant_words": f"WITH {_WORDS}, w AS (SELECT DISTINCT word FROM words WHERE lang = 'de'), {_READINGS} SELECT word, mask, variant FROM reading",
}

QUERIES |= queries_settings.QUERIES | queries_words.QUERIES
SQL |= queries_settings.SQL | queries_words.sql(_WORDS, _KEY)
