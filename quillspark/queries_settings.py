"""Registered queries of settings, languages, sources, lexicons, reports and sessions, and their SQL.

Each takes its cases from whole tables and runs the engine's own functions over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import text as X
from .operators import capture, compounds, lexicon, ranges, report, suggest, tokens
from .plans import policy, registry
from .schema import TAGS
from .sources import files, resources
from .sources.stage import own_dir
from .streaming import sessions, timed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nth(values: tuple[str | None, ...], at: Column) -> Column:
    """values[at % len(values)]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _sql_nth(values: tuple[str | None, ...], at: str) -> str:
    return f"[{', '.join('NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][{at} % {len(values)} + 1]"


def settings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's settings as TOML, global and project, read, merged, written and read again."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, name, region in batch.itertuples(index=False):
                above = policy.parse(f'dictionaries = ["EN_US", "Fr"]\nwords = ["{name}", "Zulu"]\nignore_patterns = ["b"]\nunknown = 1\n' + (f"min_word_length = {key % 5}\n" if key % 2 == 0 else ""))
                own = policy.parse(f'dictionaries = ["de"]\nwords = ["{name.lower()}", "{region}"]\nflag_words = ["{region}"]\nignore_patterns = ["a", "b"]\n[[overrides]]\npaths = ["**/{region}/*"]\nextra_dictionaries = ["X{key % 3}"]\n[[overrides]]\npaths = []\nwords = ["none"]\n')
                both = above.merged(own)
                again = policy.parse(policy.render(both))
                grown, new = both.with_item("words", name.title())
                more, fresh = both.with_item("ignore_paths", f"p{key}/**")
                for_path = both.resolved(f"a/{region}/file")
                out.append((key, ",".join(again.dictionaries), ",".join(again.words), ",".join(again.ignore_patterns), again.min_length(), ",".join(again.all_dictionary_ids()), again == both, new, fresh and more.ignores(f"p{key}/x/y") and not more.ignores(f"q{key}/x"), both.allows(name.swapcase()) and both.flags(region.lower()) and not both.flags(name), len(again.overrides), ",".join(for_path.dictionaries)))
            yield pd.DataFrame(out, columns=["n_nationkey", "dictionaries", "words", "ignore_patterns", "min_length", "all_ids", "same", "new_word", "new_path", "lookups", "overrides", "path_dictionaries"])

    return rows.mapInPandas(run, "n_nationkey int, dictionaries string, words string, ignore_patterns string, min_length long, all_ids string, same boolean, new_word boolean, new_path boolean, lookups boolean, overrides long, path_dictionaries string")


GLOBS = ("src1*", "src?/*", "**/1*.txt", "src[2-4]/**", "src[!0-8]/*", "none/**", "src0/[", "src1**/x", "src3/1?.txt", "*")
GLOB_SQL = ("^src1.*$", "^src./.*$", "^(.*/)?1.*[.]txt$", "^src[2-4]/.*$", "^src[^0-8]/.*$", "^none/.*$", None, None, "^src3/1.[.]txt$", ".*")


def glob_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths each glob matches, separators of both kinds; globs that are not valid match nothing."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.when(F.col("doc_id") % 3 == 0, F.lit("\\")).otherwise(F.lit("/")), F.col("doc_id").cast("string"), F.lit(".txt"))
    hits = [F.struct(F.lit(k).cast("long").alias("glob"), policy.path_matches(path, (g,), windows=True).alias("hit")) for k, g in enumerate(GLOBS)]
    return docs.select("doc_id", F.inline(F.array(*hits))).groupBy("glob").agg(F.count_if("hit").alias("n"), F.max(F.when(F.col("hit"), F.col("doc_id"))).alias("last"))


TAG_CASES = ((("comment", "string"), ("comment.line",)), ((), ("identifier",)), (("identifier.function", "string.special"), ()), (("strin",), ()), ((), ()))


def tag_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tags are checked, for lists of included and excluded ones, over the events' tags."""
    tag = nth((*TAGS, "commentary", "stringy.x"), F.col("event_id"))
    cases = [F.struct(F.lit(k).cast("long").alias("case"), X.tag_checked(F.col("tag"), list(i), list(e)).alias("checked")) for k, (i, e) in enumerate(TAG_CASES)]
    return table(spark, sf_dir, "events").select(tag.alias("tag")).select("tag", F.inline(F.array(*cases))).groupBy("tag", "case").agg(F.count_if("checked").alias("n"))


def _tag_sql() -> str:
    one = lambda xs: " OR ".join(f"tag = '{x}' OR starts_with(tag, '{x}.')" for x in xs) or "false"
    cases = " UNION ALL ".join(f"SELECT tag, {k} AS \"case\", NOT ({one(e)}) AND ({'true' if not i else one(i)}) AS checked FROM t" for k, (i, e) in enumerate(TAG_CASES))
    return f"WITH t AS (SELECT {_sql_nth((*TAGS, 'commentary', 'stringy.x'), 'event_id')} AS tag FROM events) SELECT tag, CAST(\"case\" AS BIGINT) AS \"case\", count(*) FILTER (checked) AS n FROM ({cases}) GROUP BY 1, 2"


IDS = ("python3", "rs", "c++", "shell script", "vue.js", "yml", "Python", "justfile", None, "R", "svelte", "nothing")
ID_LANGUAGES = ("Python", "Rust", "Cpp", "Bash", "HTML", "YAML", "Text", "Just", None, "R", "HTML", "Text")
PATHS = ("a/b.py", "a\\b.Py", "Justfile", "x.tar.md", ".rs", None)
PATH_LANGUAGES = ("Python", "Text", "Just", "Markdown", "Rust", "Text")


def language_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language that is named, else the path's, else plain text."""
    e = table(spark, sf_dir, "events").select("event_id", nth(IDS, F.col("event_id")).alias("language"), nth(PATHS, F.floor(F.col("event_id") / 12)).alias("path"))
    resolved = files.with_language(e)
    return resolved.select("event_id", "language", registry.path_key(F.col("path")).alias("key"))


def dictionary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry knows of ids: kind and transliteration, affix dictionaries first."""
    ids = table(spark, sf_dir, "customer").select("c_custkey", nth(("de_at", "rust", "nobody", "en_us", "csharp"), F.col("c_custkey")).alias("dictionary"))
    return ids.join(F.broadcast(registry.registry_table(spark)), "dictionary", "left").select("c_custkey", "dictionary", "kind", "transliterated")


def files_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files, found again by a directory, a file and globs, and read; ignore files and hidden names are heeded."""
    root = own_dir(spark, "files")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        for batch in batches:
            for page, html in batch.itertuples(index=False):
                site = f"{at}/{'.hidden' if page % 6 == 5 else f'site{page % 6}'}/{'skip' if page % 4 == 1 else 'keep'}"
                store.create_dir(site, recursive=True)
                with store.open_output_stream(f"{site}/page{page}.html") as out:
                    out.write((b"\xff" if page % 10 == 0 else b"") + (html or "").encode())
                if page % 6 == 1:
                    with store.open_output_stream(f"{at}/site1/.gitignore") as out:
                        out.write(b"# rules\nskip/\npage1?.html\n!page13.html\n")
            yield batch[["page_id"]]

    written = table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(write, "page_id long")
    if not written.count():
        return spark.createDataFrame([], "path string, bytes long, state string, failed boolean")
    local = root.removeprefix("file://")
    paths, failed = files.resolve_paths(["site1", "site2/keep", "./site3/*/page*7.html", "site4/keep/page4.html", "site9/*", "**x"], local)
    if not paths:
        return spark.createDataFrame([], "path string, bytes long, state string, failed boolean")
    read = files.admitted(files.read_files(spark, paths, local), policy.Settings(ignore_paths=("site2/keep/page2.html",), include_paths=("site1/**", "site[2-4]/*/*[0-8].html")))
    return read.select("path", F.octet_length("text").cast("long").alias("bytes"), "state", F.lit(failed).alias("failed"))


def word_list_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of part names as a word list with comments and blank lines, read as a lexicon."""
    path = own_dir(spark, "words")
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    lines = words.select(F.explode(F.array(F.initcap("w"), F.concat(F.lit("#"), "w"), F.lit(""), F.concat(F.lit(" "), "w"))).alias("value"))
    lines.write.text(path)
    return lexicon.read_word_list(spark, path, "parts")


def combined_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"))).unionByName(table(spark, sf_dir, "part").select(F.substring("p_brand", 1, 1).alias("word")))
    return lexicon.combined_list(lists)


AFFIXES = "FLAG short\nTRY abc\nPFX U Y 1\nPFX U 0 un .\nSFX S Y 3\nSFX S y ies [^aeiou]y\nSFX S 0 s [^sy]\nSFX S 0 es s\nSFX N N 1\nSFX N e ing e\nNOSUGGEST X\nONLYINCOMPOUND O\n"


def affix_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of the words of part names: plurals, prefixes that cross with them, and a suffix that does not."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    flags = F.when(F.length("w") % 4 == 0, "US").when(F.length("w") % 4 == 1, "NUX").when(F.length("w") % 4 == 2, "SO").otherwise("")
    lines = words.select(F.concat("w", F.when(flags != "", F.lit("/")).otherwise(""), flags).alias("value"))
    return lexicon.affixes(lines, lexicon.parse_affixes(AFFIXES), "forms").select("word", "fold_key", "suggested")


COMPOUNDS = "COMPOUNDFLAG C\nCOMPOUNDBEGIN B\nCOMPOUNDEND E\nONLYINCOMPOUND O\nCOMPOUNDMIN 3\nSFX F Y 1\nSFX F 0 s/BO .\n"


def compound_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words written together from part names are compounds, where words may stand anywhere, first, or last and with an s first."""
    names = table(spark, sf_dir, "part").where("p_name LIKE '% %'").select(F.split("p_name", " ").alias("x")).distinct()
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    flags = F.when(F.length("w") % 3 == 0, "C").when(F.length("w") % 3 == 1, "B").otherwise("EF")
    known = compounds.parts(words.select(F.concat_ws("/", "w", flags).alias("value")), lexicon.parse_affixes(COMPOUNDS), "parts")
    one, two = F.col("x")[0], F.col("x")[1]
    asked = names.select(F.explode(F.array(one, F.concat(one, two), F.concat(two, one), F.concat(one, F.lit("s"), two), F.concat(two, F.lit("s"), one, one), F.concat(one, two, one, two))).alias("word"))
    return compounds.known_compounds(asked.withColumn("fold_key", X.fold_key(F.col("word"))), known)


def editor_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options from JSON payloads: whole, partial, malformed and absent."""
    payload = nth(('{"checkWhileTyping": false, "diagnosticSeverity": "ERROR", "logLevel": "Debug", "globalConfigPath": "~/q.toml"}', '{"diagnosticSeverity": "hint", "extra": [1]}', "{}", "no json", "", None), F.col("event_id"))
    o = table(spark, sf_dir, "events").select("event_id", files.init_options(payload).alias("o"))
    return o.select("event_id", "o.check_while_typing", "o.severity", "o.log_level", "o.global_config", X.severity(F.col("o.severity")).cast("long").alias("number"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for the first `la` and the first `de` of each document, aligned within its source, with what could be meant."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    places = None
    for word in ("la", "de"):
        at = F.octet_length(F.substring_index("text", f" {word} ", 1)).cast("long") + 1
        one = docs.where(f"instr(text, ' {word} ') > 0").select(F.concat(F.lit("./"), "source").alias("path"), "doc_id", F.lit(word).alias("word"), at.alias("start_byte"), X.line_col(F.col("text"), at).alias("p")).select("path", "doc_id", "word", "start_byte", "p.*")
        places = one if places is None else places.unionByName(one)
    hints = spark.createDataFrame([("la", ["le", "las"]), ("de", [])], "word string, suggestions array<string>")
    return report.lines(places, suggestions=hints)


def round_robin_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of orders by lists in turns: the first of each list, then the second; the first of equal ones stays, five at most."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("source"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 10).alias("item"))
    return suggest.round_robin(rows, ["l_orderkey"]).select("l_orderkey", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


def back_off_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as attempts, errors as failures: the wait after each, cleared by any other event; a user's tenth failure in a row is for good."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, waits, failures = [], resources.BackOff(), 0
        for event, kind in rows.sort_values("event_id")[["event_id", "event_type"]].itertuples(index=False):
            now = float(event)
            if kind == "error":
                failures += 1
                wait = waits.failed("id", now, failures % 10 == 0)
            else:
                waits.clear("id")
                failures, wait = 0, 0
            out.append((event, wait, waits.ready("id", now), waits.ready("id", now + wait), int(min(waits.next_wait(now), 10**6))))
        return pd.DataFrame(out, columns=["event_id", "wait", "ready", "ready_later", "next_wait"])

    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").groupBy("user_id").applyInPandas(run, "event_id long, wait long, ready boolean, ready_later boolean, next_wait long")


def unicode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between signs of other scripts, numbers and all kinds of white space, with their bytes."""
    text = F.concat(F.col("n_name"), F.lit("\u00a0getUserID\u3000日本 ab漢字 c3po x2 "), F.lower("n_name"), F.lit("\u202fHTTPServer's éà_ß don't 12 a.b"))
    docs = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))
    return tokens.token_rows(docs.withColumn("skip", ranges.skip_ranges(F.col("text"))), "text", F.col("skip"), ["n_nationkey"])


FENCES = ("python", "Ruby", "nolanguage", "", "C")


def markdown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown with fenced code: text is plain, code is what its language has, unknown languages go."""
    lang = nth(FENCES, F.col("conv_id") + F.col("turn"))
    sign = F.when(lang == "C", "// ").otherwise("# ")
    text = F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n\n```"), lang, F.lit("\n"), sign, F.col("role"), F.lit(" é\n```\n- end "), F.col("role"), F.lit("\n"))
    docs = files.spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), F.lit("Markdown").alias("language")))
    return capture.region_rows(docs, ["conv_id", "turn"])


def languages_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of pages: their own and those of scripts and styles."""
    pages = files.spread(table(spark, sf_dir, "pages").select("page_id", "html")).withColumn("area", capture.region_array(F.col("html"), F.lit("HTML")))
    return pages.select("page_id", F.array_join(capture.languages_of(F.col("area"), F.lit("HTML")), ",").alias("languages"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    op = F.when(F.col("turn") == 0, "open").when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 3), "close").when(F.col("turn") % 5 == 4, "save").otherwise("change")
    return turns.select(F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("version"), F.col("role").alias("language_id"), op.alias("op"), F.when(op != "close", F.col("text")).alias("text"))


def due_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that call for a check, with typing checked and without."""
    e = _turns(spark, sf_dir)
    return sessions.due(e).withColumn("typing", F.lit(True)).unionByName(sessions.due(e, False).withColumn("typing", F.lit(False))).groupBy("typing", "op").agg(F.count("*").alias("n"))


def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of results for all versions of all documents, those whose document is open and still at that version."""
    e = _turns(spark, sf_dir)
    results = e.select("uri", "version", F.length("text").cast("long").alias("n"))
    return sessions.still_current(results, sessions.current(e.withColumn("seq", F.col("version"))))


def _in_parts(spark: SparkSession, sf_dir: str, base: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Turns arrive in three parts; the stream is stopped after each and goes on from its checkpoint with the next."""
    turns = _turns(spark, sf_dir)
    for low, high in ((0, 2), (2, 4), (4, 1 << 62)):
        turns.where((F.col("version") >= low) & (F.col("version") < high)).write.mode("append").parquet(f"{base}/events")
        start(spark.readStream.schema(turns.schema).parquet(f"{base}/events")).awaitTermination()


def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are open after a stream of turns, from keyed state, batch by batch over three runs."""
    base = own_dir(spark, "stream")

    def keep(docs: DataFrame, batch: int) -> None:
        docs.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{base}/states")

    def start(events: DataFrame) -> StreamingQuery:
        return sessions.tracked(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    _in_parts(spark, sf_dir, base, start)
    states = spark.read.schema("uri string, version long, language_id string, text string, open boolean, batch int").parquet(f"{base}/states")
    last = states.groupBy("uri").agg(F.max_by(F.struct("version", "language_id", "text", "open"), F.col("batch")).alias("s"))
    return last.where("s.open").select("uri", "s.version", "s.language_id", "s.text")


def documents_after_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a stream with timers has in its state after three runs, read from the state store."""
    base = own_dir(spark, "stream")

    def start(events: DataFrame) -> StreamingQuery:
        with timed.rocksdb(spark, idle=False):
            checks = timed.due_checks(events, 3_600_000).writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
            return checks.option("path", f"{base}/due").format("parquet").trigger(availableNow=True).start()

    _in_parts(spark, sf_dir, base, start)
    return timed.open_documents(spark, f"{base}/checkpoint").select("uri", "version", "language_id", "text")


QUERIES = {f.__name__: f for f in (
    settings_merged, glob_cases, tag_cases, language_resolution, dictionary_kinds, files_as_documents, word_list_lexicon, combined_word_list, affix_forms, compound_words, editor_options, report_lines,
    round_robin_lists, back_off_by_user, unicode_tokens, markdown_regions, languages_of_pages, due_events, current_results, streamed_documents, documents_after_restarts,
)}

_PATH = "coalesce(source, 'none') || '/' || doc_id || '.txt'"
_TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS uri, turn AS version, role AS language_id, text,
  CASE WHEN turn = 0 THEN 'open' WHEN conv_id % 7 = 0 AND turn = 3 THEN 'close' WHEN turn % 5 = 4 THEN 'save' ELSE 'change' END AS op FROM conversations),
opened AS (SELECT t.*, (SELECT max(version) FROM turns o WHERE o.uri = t.uri AND o.op <> 'save') AS last FROM turns t
  WHERE EXISTS (SELECT 1 FROM turns o WHERE o.uri = t.uri AND o.op = 'open') AND NOT EXISTS (SELECT 1 FROM turns o WHERE o.uri = t.uri AND o.op = 'close'))"""
_LIST = lambda name: f"SELECT DISTINCT unnest(string_split(p_name, ' ')) AS {name} FROM part"

SQL = {
    "settings_merged": """SELECT n_nationkey, 'de,en_us,fr' AS dictionaries, (SELECT string_agg(x, ',' ORDER BY lower(x)) FROM (SELECT unnest([n_name, r_name, 'Zulu']) AS x)) AS words, 'b,a,b' AS ignore_patterns,
  CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 5 ELSE 3 END AS BIGINT) AS min_length, 'de,en_us,fr,x' || (n_nationkey % 3) AS all_ids, true AS same, false AS new_word, true AS new_path, true AS lookups, CAST(1 AS BIGINT) AS overrides,
  'de,en_us,fr,x' || (n_nationkey % 3) AS path_dictionaries FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "glob_cases": " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS glob, count(*) FILTER (hit) AS n, max(doc_id) FILTER (hit) AS last FROM (SELECT doc_id, {'false' if g is None else f'regexp_matches({_PATH}, {chr(39)}{g}{chr(39)})'} AS hit FROM documents) HAVING count(*) > 0"
        for k, g in enumerate(GLOB_SQL)
    ),
    "tag_cases": _tag_sql(),
    "language_resolution": f"""SELECT event_id, coalesce({_sql_nth(ID_LANGUAGES, 'event_id')}, {_sql_nth(PATH_LANGUAGES, '(event_id // 12)')}) AS language, {_sql_nth(('py', 'Py', 'Justfile', 'md', 'rs', None), '(event_id // 12)')} AS key FROM events""",
    "dictionary_kinds": f"""SELECT c_custkey, {_sql_nth(('de_at', 'rust', 'nobody', 'en_us', 'csharp'), 'c_custkey')} AS dictionary, {_sql_nth(('affix', 'list', None, 'affix', 'list'), 'c_custkey')} AS kind, [true, false, NULL, false, false][c_custkey % 5 + 1] AS transliterated FROM customer""",
    "files_as_documents": """WITH f AS (SELECT page_id, page_id % 6 AS site, CASE WHEN page_id % 4 = 1 THEN 'skip' ELSE 'keep' END AS folder, page_id % 10 = 0 AS broken, html FROM pages)
SELECT 'site' || site || '/' || folder || '/page' || page_id || '.html' AS path, CASE WHEN NOT broken THEN CAST(strlen(coalesce(html, '')) AS BIGINT) END AS bytes,
  CASE WHEN page_id = 2 THEN 'ignored' WHEN site = 1 OR (site BETWEEN 2 AND 4 AND page_id % 10 <= 8) THEN 'checked' ELSE 'excluded' END AS state, true AS failed FROM f
WHERE (site = 1 AND folder = 'keep' AND (page_id NOT BETWEEN 10 AND 19 OR page_id = 13)) OR (site = 2 AND folder = 'keep') OR (site = 3 AND page_id % 10 = 7) OR page_id = 4""",
    "word_list_lexicon": f"""SELECT 'parts' AS dictionary, word, lower(word) AS fold_key FROM ({_LIST('w')}), LATERAL (SELECT unnest([upper(w[1]) || lower(w[2 :]), ' ' || w]) AS word)""",
    "combined_word_list": f"SELECT DISTINCT lower(word) AS word FROM ({_LIST('word')} UNION ALL SELECT n_name FROM nation) WHERE length(word) > 1",
    "compound_words": f"""WITH RECURSIVE w AS ({_LIST('w')}), p AS (
  SELECT w AS part, length(w) % 3 <= 1 AS f, length(w) % 3 = 0 AS i, length(w) % 3 <> 1 AS l FROM w UNION SELECT w || 's', true, false, false FROM w WHERE length(w) % 3 = 2
), n AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part WHERE p_name LIKE '% %'),
asked AS (SELECT DISTINCT unnest([a, a || b, b || a, a || 's' || b, b || 's' || a || a, a || b || a || b]) AS word FROM n), r AS (
  SELECT word, 1 + length(part) AS pos FROM asked JOIN p ON f AND length(part) >= 3 AND length(part) < length(word) AND starts_with(word, part)
  UNION SELECT word, pos + length(part) FROM r JOIN p ON length(part) >= 3 AND word[pos : pos + length(part) - 1] = part AND ((i AND pos + length(part) <= length(word)) OR (l AND pos + length(part) = length(word) + 1))
) SELECT DISTINCT word FROM r WHERE pos = length(word) + 1""",
    "affix_forms": f"""WITH w AS ({_LIST('w')}), s AS (
  SELECT w, length(w) % 4 AS kind, CASE WHEN regexp_matches(w, '[^aeiou]y$') THEN w[1 : length(w) - 1] || 'ies' WHEN regexp_matches(w, '[^sy]$') THEN w || 's' WHEN regexp_matches(w, 's$') THEN w || 'es' END AS plural FROM w
), f AS (
  SELECT unnest([w, 'un' || w, plural, 'un' || plural]) AS word, true AS ok FROM s WHERE kind = 0
  UNION ALL SELECT unnest([w, 'un' || w, CASE WHEN regexp_matches(w, 'e$') THEN w[1 : length(w) - 1] || 'ing' END]), false FROM s WHERE kind = 1
  UNION ALL SELECT plural, true FROM s WHERE kind = 2
  UNION ALL SELECT w, true FROM s WHERE kind = 3
) SELECT word, lower(word) AS fold_key, bool_or(ok) AS suggested FROM f WHERE word IS NOT NULL GROUP BY word""",
    "editor_options": f"""SELECT event_id, event_id % 6 <> 0 AS check_while_typing, {_sql_nth(('error', 'hint', 'information', 'information', 'information', 'information'), 'event_id')} AS severity,
  CASE WHEN event_id % 6 = 0 THEN 'debug' ELSE 'info' END AS log_level, CASE WHEN event_id % 6 = 0 THEN '~/q.toml' END AS global_config, CAST([1, 4, 3, 3, 3, 3][event_id % 6 + 1] AS BIGINT) AS number FROM events""",
    "report_lines": r"""WITH p AS (
  SELECT source, w AS word, text[1 : strpos(text, ' ' || w || ' ')] AS head FROM documents, (SELECT unnest(['la', 'de']) AS w) WHERE source IS NOT NULL AND strpos(text, ' ' || w || ' ') > 0
), q AS (
  SELECT source, word, CAST(strlen(head) AS BIGINT) AS start_byte, (length(head) - length(replace(head, chr(10), '')) + 1) || ':' || (length(regexp_extract(head, '[^\n]*$')) + 1) AS spot FROM p
)
SELECT './' || source AS path, start_byte, '  ' || source || ':' || rpad(spot, CAST(max(length(spot)) OVER (PARTITION BY source) AS INTEGER), ' ') || '  ' || word || CASE WHEN word = 'la' THEN '  -> le, las' ELSE '' END AS value FROM q""",
    "round_robin_lists": """WITH f AS (SELECT l_orderkey, l_partkey % 10 AS item, min((l_linenumber, l_linenumber % 3)) AS spot FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY spot, item) AS n FROM f) SELECT l_orderkey, string_agg(item, ',' ORDER BY n) AS items FROM r WHERE n <= 5 GROUP BY 1""",
    "back_off_by_user": """WITH e AS (SELECT event_id, user_id, event_type = 'error' AS bad, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
n AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY user_id, run ORDER BY event_id) AS n, (count(*) FILTER (bad) OVER (PARTITION BY user_id, run ORDER BY event_id)) // 10 AS tens FROM e),
g AS (SELECT *, max(CASE WHEN n % 10 = 0 AND bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS gone FROM n)
SELECT event_id, CAST(CASE WHEN bad AND n % 10 <> 0 THEN least(30 * pow(2, least(n - 1 - tens, 7)), 3600) ELSE 0 END AS BIGINT) AS wait, NOT bad AND NOT gone AS ready, NOT gone AS ready_later,
  CAST(CASE WHEN bad AND n % 10 <> 0 THEN least(30 * pow(2, least(n - 1 - tens, 7)), 3600) ELSE 21600 END AS BIGINT) AS next_wait FROM g""",
    "unicode_tokens": """WITH t AS (SELECT n_nationkey, n_name, strlen(n_name) AS a, strlen(n_name) + strlen(chr(160) || 'getUserID' || chr(12288) || '日本 ab漢字 c3po x2 ') AS b FROM nation),
w AS (
  SELECT n_nationkey, unnest([split_part(n_name, '_', 1), 'get', 'User', 'ID', lower(split_part(n_name, '_', 1)), 'HTTP', 'Server''s', 'éà', 'ß', 'don''t', 'a', 'b', 'c', 'po', 'x', 'ab']) AS word,
    unnest([0, a + 2, a + 5, a + 9, b, b + a + 3, b + a + 7, b + a + 16, b + a + 21, b + a + 24, b + a + 33, b + a + 35, a + 11 + 3 + 6 + 1 + 8 + 1, a + 11 + 3 + 6 + 1 + 8 + 1 + 2, a + 11 + 3 + 6 + 1 + 8 + 1 + 5, a + 11 + 3 + 6 + 1]) AS s FROM t
) SELECT n_nationkey, word, CAST(s AS BIGINT) AS start_byte, CAST(s + strlen(word) AS BIGINT) AS end_byte FROM w""",
    "markdown_regions": f"""WITH m AS (SELECT conv_id, turn, role, {_sql_nth(FENCES, '(conv_id + turn)')} AS lang, strlen(CAST(turn AS VARCHAR)) AS t FROM conversations),
o AS (SELECT *, 7 + t + 2 + 3 + strlen(lang) + 1 AS body, CASE WHEN lang = 'C' THEN 3 ELSE 2 END AS sign FROM m),
r AS (
  SELECT conv_id, turn, 'string' AS tag, 'Markdown' AS language, 2 AS s, 7 + t AS e FROM o
  UNION ALL SELECT conv_id, turn, 'string', 'Markdown', body + sign + strlen(role) + 3 + 1 + 4 + 2, body + sign + strlen(role) + 3 + 1 + 4 + 6 + strlen(role) FROM o
  UNION ALL SELECT conv_id, turn, 'comment', CASE lang WHEN 'python' THEN 'Python' WHEN 'Ruby' THEN 'Ruby' ELSE 'C' END, body, body + sign + strlen(role) + 3 FROM o WHERE lang IN ('python', 'Ruby', 'C')
) SELECT conv_id, turn, tag, language, CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte FROM r""",
    "languages_of_pages": "SELECT page_id, 'Css,HTML,Typescript' AS languages FROM pages",
    "due_events": f"WITH {_TURNS} SELECT true AS typing, op, count(*) AS n FROM turns WHERE op <> 'close' GROUP BY op UNION ALL SELECT false, op, count(*) FROM turns WHERE op = 'save' GROUP BY op",
    "current_results": f"WITH {_TURNS} SELECT uri, version, CAST(length(text) AS BIGINT) AS n FROM opened WHERE version = last",
    "streamed_documents": f"WITH {_TURNS} SELECT uri, max(last) AS version, min_by(language_id, version) AS language_id, max_by(text, version) AS text FROM opened GROUP BY uri",
}
SQL["documents_after_restarts"] = SQL["streamed_documents"]
