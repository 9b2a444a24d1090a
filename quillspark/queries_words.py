"""Registered queries of affix dictionaries, compounds and suggestions, and their SQL.

Dictionaries are made from the tables: the corpus's words with flags by their digests, under rules of every kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import affix, ancestors, check, compound_rules, lexicon, similar
from .sources import files
from .sources.stage import staged

LEAST_DOCS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(table(spark, sf_dir, "documents").select("text"))


def distinct_words(texts: DataFrame) -> DataFrame:
    """Each word once; a text's own are made distinct in its row."""
    return texts.select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("word")).distinct()


AFFIXES = """NEEDAFFIX n
FORBIDDENWORD x
KEEPCASE k
CIRCUMFIX c
SFX A Y 2
SFX A 0 s [^s]
SFX A 0 es s
SFX B Y 2
SFX B 0 en/A [^e]
SFX B e er/AD e
SFX D N 1
SFX D r rin [^s]r
SFX E Y 1
SFX E 0 on/nA .
SFX H Y 1
SFX H 0 ed/c .
PFX P Y 1
PFX P 0 an .
PFX Q N 1
PFX Q a in a
PFX G Y 1
PFX G 0 th/c .
"""
#: The flags of a stem: each where a digit of its digest is one of these.
FLAG_DIGITS = (("A", "01234567"), ("B", "012345"), ("E", "012"), ("P", "0123"), ("Q", "01"), ("GH", "012"), ("n", "0"), ("x", "0"), ("k", "012"))
TITLE_DIGITS = "012"


def _digit(key: Column, place: int, digits: str) -> Column:
    return F.substring(F.md5(key), place, 1).isin(*digits)


def corpus_affixed(known: DataFrame) -> affix.Affixed:
    """A dictionary of the words of a corpus lexicon (fold_key), some with a capital, with flags by their digests."""
    key = F.col("fold_key")
    flags = F.concat(*[F.when(_digit(key, k + 1, digits), flag).otherwise("") for k, (flag, digits) in enumerate(FLAG_DIGITS)])
    title = F.concat(F.upper(F.substring(key, 1, 1)), F.substr(key, F.lit(2), F.char_length(key)))
    stem = F.when(_digit(key, 10, TITLE_DIGITS), title).otherwise(key)
    rules = lexicon.parse_affixes(AFFIXES)
    return affix.read_stems(known.select(F.concat(stem, F.lit("/"), flags).alias("value")), rules, "corpus")


def affix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents that the corpus's affix dictionary has, with its number of readings and the least form it stands for."""
    texts = texts_of(spark, sf_dir)
    known = corpus_affixed(staged(lexicon.text_lexicon(texts, "text", LEAST_DOCS)))
    found = affix.readings(staged(distinct_words(texts)), known)
    return found.groupBy("word").agg(F.count("*").alias("n_readings"), F.min("form").alias("form"))


_AFFIX_SQL = rf"""
rule AS (SELECT * FROM (VALUES
  ('S', 'A', true, '', 's', '[^s]$', ''), ('S', 'A', true, '', 'es', 's$', ''), ('S', 'B', true, '', 'en', '[^e]$', 'A'), ('S', 'B', true, 'e', 'er', 'e$', 'AD'), ('S', 'D', false, 'r', 'rin', '[^s]r$', ''),
  ('S', 'E', true, '', 'on', '.$', 'nA'), ('S', 'H', true, '', 'ed', '.$', 'c'), ('P', 'P', true, '', 'an', '^.', ''), ('P', 'Q', false, 'a', 'in', '^a', ''), ('P', 'G', true, '', 'th', '^.', 'c')
) AS t(side, flag, crosses, strip, adds, cond, more)),
stem AS (
  SELECT CASE WHEN md5(k)[10] IN ({', '.join(repr(d) for d in TITLE_DIGITS)}) THEN upper(k[1]) || k[2 :] ELSE k END AS stem,
         {' || '.join(f"CASE WHEN md5(k)[{n + 1}] IN ({', '.join(repr(d) for d in digits)}) THEN '{flag}' ELSE '' END" for n, (flag, digits) in enumerate(FLAG_DIGITS))} AS flags
  FROM (SELECT fold_key AS k FROM lex)
), once AS (
  SELECT stem, flags, stem AS form, false AS s, true AS s_x, '' AS s_more, false AS t, '' AS t_more FROM stem
  UNION ALL SELECT stem, flags, stem[1 : length(stem) - length(strip)] || adds, true, crosses, more, false, ''
  FROM stem JOIN rule ON side = 'S' AND contains(flags, flag) AND ends_with(stem, strip) AND regexp_matches(stem, cond) AND length(stem) > length(strip)
), twice AS (
  SELECT * FROM once UNION ALL
  SELECT stem, flags, form[1 : length(form) - length(strip)] || adds, true, s_x AND crosses, s_more, true, more
  FROM once JOIN rule ON s AND side = 'S' AND contains(s_more, flag) AND ends_with(form, strip) AND regexp_matches(form, cond) AND length(form) > length(strip)
), form AS (
  SELECT *, false AS p, '' AS p_more FROM twice UNION ALL
  SELECT stem, flags, adds || form[length(strip) + 1 :], s, s_x, s_more, t, t_more, true, more
  FROM twice JOIN rule ON side = 'P' AND contains(flags, flag) AND starts_with(form, strip) AND regexp_matches(form, cond) AND length(form) > length(strip) AND (NOT s OR (s_x AND crosses))
), right_form AS (
  SELECT form, contains(flags, 'k') AS keep FROM form
  WHERE NOT contains(flags, 'x') AND (NOT contains(flags, 'n') OR s OR p) AND (NOT contains(s_more, 'n') OR t OR p) AND (NOT contains(t_more, 'n') OR p) AND (NOT contains(p_more, 'n') OR s)
    AND contains(p_more, 'c') = (contains(s_more, 'c') OR contains(t_more, 'c'))
), met AS (
  SELECT word, form, keep, NOT regexp_matches(word, '[\p{{Lu}}\p{{Lt}}]') AS small, NOT regexp_matches(word, '\p{{Ll}}') AS capital,
         regexp_matches(word, '^[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(word[2 :], '[\p{{Lu}}\p{{Lt}}]') AS title
  FROM (SELECT DISTINCT word FROM words) JOIN right_form ON KEY_WORD = KEY_FORM
), stands AS (
  SELECT word, form FROM met
  WHERE word = form OR (NOT keep AND ((title AND lower(word) = form) OR (capital AND lower(word) = lower(form))))
     OR (small AND (upper(word[1]) || word[2 :] = form OR upper(word) = form OR (NOT keep AND lower(word) = lower(form))))
)
SELECT word, count(*) AS n_readings, min(form) AS form FROM stands WHERE form NOT IN (SELECT stem FROM stem WHERE contains(flags, 'x')) GROUP BY word
"""

#: Ordinals, and names of parts in a row of kinds.
COMPOUNDS = """COMPOUNDMIN 1
FORBIDDENWORD x
CHECKCOMPOUNDCASE
CHECKCOMPOUNDTRIPLE
CHECKCOMPOUNDPATTERN 2
CHECKCOMPOUNDPATTERN l r
CHECKCOMPOUNDPATTERN e/k g
COMPOUNDRULE 3
COMPOUNDRULE n*1t
COMPOUNDRULE n*mp
COMPOUNDRULE j*k?q
"""
NUMBER_PARTS = tuple(f"{k}/n{'1' if k == 1 else 'm'}" for k in range(10)) + ("1st/p", "2nd/p", "3rd/p", *(f"{k}th/{'t' if 0 < k < 4 else 'pt'}" for k in range(10)))
ENDINGS = ("st", "nd", "rd", "th")


def rule_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which numbers of orders are right ordinals with each line's ending, and which part names written together are compounds by rule."""
    names = table(spark, sf_dir, "part").where("p_name LIKE '% %'").select(F.split("p_name", " ").alias("x")).distinct()
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    kind = F.when(F.length("w") % 3 == 0, "j").when(F.length("w") % 3 == 1, "kq").otherwise("q")
    lines = w.select(F.concat_ws("/", "w", kind).alias("value")).unionByName(spark.createDataFrame([(x,) for x in NUMBER_PARTS], "value string"))
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    numbers = table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), ending).alias("word"))
    a, b = F.col("x")[0], F.col("x")[1]
    both = names.select(F.explode(F.array(a, F.concat(a, b), F.concat(b, a), F.concat(a, a, b), F.concat(a, b, a, b), F.concat(b, F.initcap(a)), F.initcap(F.concat(a, b)))).alias("word"))
    known = affix.read_stems(lines, lexicon.parse_affixes(COMPOUNDS), "parts")
    return compound_rules.accepted(numbers.unionByName(both), known)


_COMPOUND_SQL = f"""
WITH RECURSIVE name AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
part_of AS (
  SELECT w AS part, CASE length(w) % 3 WHEN 0 THEN 'j' WHEN 1 THEN 'kq' ELSE 'q' END AS flags FROM name
  UNION ALL SELECT unnest([{', '.join(repr(x.split('/')[0]) for x in NUMBER_PARTS)}]), unnest([{', '.join(repr(x.split('/')[1]) for x in NUMBER_PARTS)}])
), step AS (SELECT * FROM (VALUES
  (0, 'n', 1), (1, 'n', 1), (0, '1', 2), (1, '1', 2), (2, 't', 3), (0, 'n', 4), (4, 'n', 4), (0, 'm', 5), (4, 'm', 5), (5, 'p', 6), (0, 'j', 7), (7, 'j', 7), (0, 'k', 8), (7, 'k', 8), (0, 'q', 9), (7, 'q', 9), (8, 'q', 9)
) AS t(state, flag, next)), pair AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part WHERE p_name LIKE '% %'),
asked AS (
  SELECT DISTINCT l_orderkey || ['st', 'nd', 'rd', 'th'][l_linenumber % 4 + 1] AS word FROM lineitem
  UNION SELECT unnest([a, a || b, b || a, a || a || b, a || b || a || b, b || upper(a[1]) || a[2 :], upper(a[1]) || a[2 :] || b]) FROM pair
), walk AS (
  SELECT word, 1 + length(part) AS pos, next, part, flags FROM asked JOIN part_of ON starts_with(lower(word), part) AND length(part) < length(word) JOIN step ON state = 0 AND contains(flags, flag)
  UNION
  SELECT word, pos + length(p.part), s.next, p.part, p.flags
  FROM walk w JOIN part_of p ON lower(word)[pos : pos + length(p.part) - 1] = p.part
    AND NOT (ends_with(w.part, 'l') AND starts_with(p.part, 'r')) AND NOT (ends_with(w.part, 'e') AND contains(w.flags, 'k') AND starts_with(p.part, 'g'))
    AND NOT regexp_matches(word[pos - 1 : pos], '\\p{{Lu}}')
    AND NOT (word[pos - 1] = word[pos] AND ((pos > 2 AND word[pos - 2] = word[pos]) OR word[pos + 1] = word[pos]))
  JOIN step s ON s.state = w.next AND contains(p.flags, s.flag)
)
SELECT DISTINCT word FROM walk WHERE pos = length(word) + 1 AND next IN (3, 6, 9)
"""

QUERIES = {f.__name__: f for f in (affix_check, rule_compounds)}

#: A suggestion in the case of the word that it is for.
_RECASED = r"""CASE WHEN regexp_full_match(word, '\p{Lu}+') THEN translate(suggestion, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
  WHEN regexp_full_match(word, '\p{Ll}+') THEN translate(suggestion, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE suggestion END"""


def sql(words: str, key: str) -> dict[str, str]:
    """`words` are CTEs of all words of documents and the corpus's lexicon; `key` the fold key of a column."""
    return {
        "affix_check": f"WITH {words}, {_AFFIX_SQL.replace('KEY_WORD', key.format('word')).replace('KEY_FORM', key.format('form'))}",
        "rule_compounds": _COMPOUND_SQL,
        "captures_without_ancestors": _CAPTURES_SQL,
    } | _similar_sql(words, key, _RECASED)


def _sources(customers: DataFrame) -> DataFrame:
    """A source for each customer, in one of four languages, with blocks as deep as its number says."""
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    deep = F.repeat(F.lit("{ ("), (F.col("c_custkey") % 5).cast("int"))
    back = F.repeat(F.lit(") }"), (F.col("c_custkey") % 5).cast("int"))
    texts = (
        ("Rust", F.concat(F.lit("impl Show for A { "), deep, F.lit("fn a"), key, F.lit('() { x("'), segment, F.lit('") }'), back, F.lit(' } #[doc = "no"]\nfn b'), key, F.lit('() { "'), name, F.lit('" } // "c"'))),
        ("Go", F.concat(F.lit('import (\n "os" '), deep, F.lit('"no"'), back, F.lit(")\nfunc f"), key, F.lit('() { p("'), segment, F.lit('", "é") }'))),
        ("Java", F.concat(F.lit('@N("no" '), deep, F.lit('"no"'), back, F.lit(") class C"), key, F.lit(' { String s = "'), name, F.lit('"; }'))),
        ("Python", F.concat(F.lit("def f"), key, F.lit('(a: D["no"] = "'), name, F.lit('", b="yes", c: "no") -> "no":\n    return {"k": '), segment, F.lit('["v"]} # "c"'))),
    )
    text = None
    for k, (_, made) in enumerate(texts):
        text = F.when(F.col("c_custkey") % 4 == k, made) if text is None else text.when(F.col("c_custkey") % 4 == k, made)
    language = F.element_at(F.array(*[F.lit(x) for x, _ in texts]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return customers.select("c_custkey", language.alias("language"), text.alias("text"))


def captures_without_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is captured of a source made for each customer, but for captures inside what their language's rules name."""
    docs = files.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return ancestors.kept_captures(_sources(docs), "c_custkey")


_CAPTURES_SQL = rf"""
WITH source AS (
  SELECT c_custkey AS id, ['Rust', 'Go', 'Java', 'Python'][c_custkey % 4 + 1] AS language, repeat('{{ (', CAST(c_custkey % 5 AS INTEGER)) AS deep, repeat(') }}', CAST(c_custkey % 5 AS INTEGER)) AS back, c_name, c_mktsegment
  FROM customer
), written AS (
  SELECT id, language, CASE language
    WHEN 'Rust' THEN 'impl Show for A {{ ' || deep || 'fn a' || id || '() {{ x("' || c_mktsegment || '") }}' || back || ' }} #[doc = "no"]' || chr(10) || 'fn b' || id || '() {{ "' || c_name || '" }} // "c"'
    WHEN 'Go' THEN 'import (' || chr(10) || ' "os" ' || deep || '"no"' || back || ')' || chr(10) || 'func f' || id || '() {{ p("' || c_mktsegment || '", "é") }}'
    WHEN 'Java' THEN '@N("no" ' || deep || '"no"' || back || ') class C' || id || ' {{ String s = "' || c_name || '"; }}'
    ELSE 'def f' || id || '(a: D["no"] = "' || c_name || '", b="yes", c: "no") -> "no":' || chr(10) || '    return {{"k": ' || c_mktsegment || '["v"]}} # "c"' END AS text
  FROM source
), cut AS (
  SELECT id, language, regexp_extract_all(text, CASE WHEN language = 'Python' THEN '{ancestors.token_pattern("hash").replace("'", "''")}' ELSE '{ancestors.token_pattern("slashes").replace("'", "''")}' END) AS t FROM written
), token AS (
  SELECT id, language, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM cut
), placed AS (
  SELECT *, sum(strlen(token)) OVER w AS e, sum(strlen(token)) OVER w - strlen(token) AS s, token IN ('{{', '(', '[') AS opens, token IN ('}}', ')', ']') AS closes,
         sum(CASE WHEN token IN ('{{', '(', '[') THEN 1 WHEN token IN ('}}', ')', ']') THEN -1 ELSE 0 END) OVER w AS run,
         regexp_extract(string_agg(token, '') OVER (PARTITION BY id ORDER BY k ROWS BETWEEN {ancestors.BEFORE} PRECEDING AND 1 PRECEDING), '[^;{{}}]*$') AS head
  FROM token WINDOW w AS (PARTITION BY id ORDER BY k)
), deep AS (
  SELECT *, run + CASE WHEN closes THEN 1 ELSE 0 END AS depth, max(e) OVER (PARTITION BY id) AS text_end,
         CASE WHEN language = 'Rust' AND token = '{{' AND regexp_matches(head, '\bimpl\b[^=]*\bfor\b') THEN 'trait_impl' WHEN language = 'Rust' AND token = '[' AND regexp_matches(head, '#!?$') THEN 'attribute'
              WHEN language = 'Go' AND token = '(' AND regexp_matches(head, '\bimport\s*$') THEN 'import' WHEN language = 'Java' AND token = '(' AND regexp_matches(head, '@[A-Za-z_.]+\s*$') THEN 'annotation'
              WHEN language = 'Python' AND token = '(' AND regexp_matches(head, '\bdef\s+[A-Za-z_0-9]+\s*$') THEN 'parameters' END AS kind
  FROM placed
), level AS (
  SELECT *, min(CASE WHEN closes THEN e END) OVER later AS close_end, min(CASE WHEN closes OR token IN (',', '=') THEN s END) OVER later AS stop, min(CASE WHEN token = ':' THEN s END) OVER later AS colon,
         last_value(CASE WHEN opens THEN coalesce(kind, '') END IGNORE NULLS) OVER (PARTITION BY id, depth ORDER BY k ROWS UNBOUNDED PRECEDING) AS inner_kind
  FROM deep WINDOW later AS (PARTITION BY id, depth ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), around AS (
  SELECT id, kind, s, coalesce(close_end, text_end) AS e FROM level WHERE kind IS NOT NULL
  UNION ALL SELECT id, 'type', s, coalesce(stop, text_end) FROM level WHERE language = 'Python' AND token = ':' AND inner_kind = 'parameters' AND depth > 0
  UNION ALL SELECT id, 'type', s, coalesce(colon, text_end) FROM level WHERE language = 'Python' AND token = '->'
), plain AS (
  SELECT *, lag(token) OVER (PARTITION BY id ORDER BY k) AS before FROM placed
  WHERE NOT regexp_matches(token, '^\s+$') AND NOT starts_with(token, '//') AND NOT (language = 'Python' AND starts_with(token, '#'))
), tagged AS (
  SELECT id, language, s, e, CASE WHEN regexp_matches(token, '^["''`]') AND length(token) > 2 THEN 'string'
    WHEN (language, before) IN (('Rust', 'fn'), ('Go', 'func'), ('Python', 'def')) THEN 'identifier.function' WHEN (language, before) IN (('Java', 'class')) THEN 'identifier.type' END AS tag
  FROM plain
)
SELECT id AS c_custkey, tag, CAST(s + CASE WHEN tag = 'string' THEN 1 ELSE 0 END AS BIGINT) AS start_byte, CAST(e - CASE WHEN tag = 'string' THEN 1 ELSE 0 END AS BIGINT) AS end_byte FROM tagged t
WHERE tag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM around a WHERE a.id = t.id AND a.s <= t.s AND t.e <= a.e AND (
  (language = 'Rust' AND ((tag = 'identifier.function' AND kind = 'trait_impl') OR (tag = 'string' AND kind = 'attribute'))) OR (tag = 'string' AND (language, kind) IN (('Go', 'import'), ('Java', 'annotation'), ('Python', 'type')))))
"""

QUERIES |= {"captures_without_ancestors": captures_without_ancestors}

#: Replacements and related letters, and the same with places as the operator numbers them.
REWRITES = "REP 7\nREP en in\nREP on$ an\nREP ^th t\nREP ly lich\nREP ou u\nREP alot a_lot\nREP nand n_and\nMAP 2\nMAP aä\nMAP eéè\n"


def rewritten_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every unknown word of documents, the known words that it is by a replacement or a related letter, or two of them in one."""
    texts = texts_of(spark, sf_dir)
    lex = staged(lexicon.text_lexicon(texts, "text", LEAST_DOCS))
    asked = distinct_words(texts).where(F.char_length("word") >= 3).withColumn("fold_key", X.fold_key(F.col("word")))
    asked = staged(asked.join(check.sized(lex.select("fold_key")), "fold_key", "left_anti"))
    rules = lexicon.parse_affixes(REWRITES)
    lists = similar.rewritten(asked, lex, rules).withColumn("source", F.lit("rewritten")).unionByName(similar.split_in_two(asked, lex).withColumn("source", F.lit("split")))
    return lists.select("word", "source", F.col("rank").cast("long").alias("rank"), "suggestion")


def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every unknown word of conversations, the known words of documents with the most similar trigrams."""
    lex = staged(lexicon.text_lexicon(texts_of(spark, sf_dir), "text", LEAST_DOCS))
    said = files.spread(table(spark, sf_dir, "conversations").select("text"))
    asked = distinct_words(said).where(F.char_length("word") >= 5).withColumn("fold_key", X.fold_key(F.col("word")))
    asked = asked.join(check.sized(lex.select("fold_key")), "fold_key", "left_anti")
    return similar.similar(staged(asked), lex).select("word", F.col("rank").cast("long").alias("rank"), "suggestion")


def _similar_sql(words: str, key: str, recased: str) -> dict[str, str]:
    places = similar.replacements(lexicon.parse_affixes(REWRITES))
    rules = ", ".join(f"('{a}', '{b}', {first}, {last}, {place})" for a, b, first, last, place in places)
    return {
        "rewritten_words": f"""WITH {words}, asked AS (
  SELECT DISTINCT word, {key.format('word')} AS key FROM words WHERE length(word) >= 3 AND {key.format('word')} NOT IN (SELECT fold_key FROM lex)
), rule AS (SELECT * FROM (VALUES {rules}) AS t(a, b, at_first, at_last, place)), spot AS (
  SELECT word, key, unnest(range(1, length(key) + 1)) AS p FROM asked
), made AS (
  SELECT word, place, p, key[1 : p - 1] || b || key[p + length(a) :] AS made FROM spot JOIN rule ON key[p : p + length(a) - 1] = a
  WHERE (NOT at_first OR p = 1) AND (NOT at_last OR p + length(a) = length(key) + 1)
), found AS (
  SELECT word, min((place, p)) AS best, made AS suggestion FROM made
  WHERE (NOT contains(made, ' ') AND made IN (SELECT fold_key FROM lex))
     OR (contains(made, ' ') AND split_part(made, ' ', 1) IN (SELECT fold_key FROM lex) AND split_part(made, ' ', 2) IN (SELECT fold_key FROM lex)) GROUP BY word, made
), halves AS (
  SELECT word, abs(2 * p - length(key)) AS odd, key[1 : p] || ' ' || key[p + 1 :] AS suggestion FROM spot
  WHERE p < length(key) AND key[1 : p] IN (SELECT fold_key FROM lex) AND key[p + 1 :] IN (SELECT fold_key FROM lex)
), ranked AS (
  SELECT word, 'rewritten' AS source, row_number() OVER (PARTITION BY word ORDER BY best, suggestion) AS rank, suggestion FROM found
  UNION ALL SELECT word, 'split', row_number() OVER (PARTITION BY word ORDER BY odd, suggestion), suggestion FROM halves
)
SELECT word, source, rank, {recased} AS suggestion FROM ranked WHERE rank <= {similar.MOST}""",
        "similar_words": rf"""WITH {words}, known AS (SELECT fold_key AS known FROM lex), asked AS (
  SELECT DISTINCT word, {key.format('word')} AS key FROM (SELECT unnest(regexp_extract_all(text, '{X.WORD_PATTERN.replace("'", "''")}')) AS word FROM conversations)
  WHERE length(word) >= 5 AND {key.format('word')} NOT IN (SELECT fold_key FROM lex)
), known_gram AS (
  SELECT DISTINCT known, gram FROM (SELECT known, unnest(list_transform(range(1, length(known) + 1), lambda i: (' ' || known || ' ')[i : i + 2])) AS gram FROM known)
), weight AS (
  SELECT gram, CAST(round(1000 * ln(1 + CAST((SELECT count(*) FROM known) AS DOUBLE) / count(*))) AS BIGINT) AS weight FROM known_gram GROUP BY gram
), asked_gram AS (
  SELECT DISTINCT key, gram FROM (SELECT key, unnest(list_transform(range(1, length(key) + 1), lambda i: (' ' || key || ' ')[i : i + 2])) AS gram FROM (SELECT DISTINCT key FROM asked))
), asked_total AS (
  SELECT key, sum(coalesce(weight, CAST(round(1000 * ln(1 + CAST((SELECT count(*) FROM known) AS DOUBLE))) AS BIGINT))) AS total FROM asked_gram LEFT JOIN weight USING (gram) GROUP BY key
), known_total AS (
  SELECT known, sum(weight) AS total FROM known_gram JOIN weight USING (gram) GROUP BY known
), common AS (
  SELECT key, known, sum(weight) AS common FROM asked_gram JOIN weight USING (gram) JOIN known_gram USING (gram) GROUP BY key, known
), scored AS (
  SELECT c.key, c.known, CAST(common AS DOUBLE) / CAST(a.total + k.total - common AS DOUBLE) AS alike FROM common c JOIN asked_total a USING (key) JOIN known_total k ON k.known = c.known
  WHERE common * 100 >= (a.total + k.total - common) * {similar.LEAST}
), ranked AS (
  SELECT word, known AS suggestion, row_number() OVER (PARTITION BY word ORDER BY alike DESC, known) AS rank FROM scored JOIN asked USING (key)
)
SELECT word, rank, {recased} AS suggestion FROM ranked WHERE rank <= {similar.MOST}""",
    }


QUERIES |= {f.__name__: f for f in (rewritten_words, similar_words)}
