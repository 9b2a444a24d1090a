"""Ancestors of captures as a relation: delimiters become nested intervals, and rules say in which a capture does not count.

Sources are cut into tokens (comments, strings, names, delimiters, other signs, white space), one row each with its bytes. A running
sum over the delimiters gives each its depth; an opening one ends at the next closing one of its depth, so blocks are intervals
(start, end, depth), nested like the blocks. What stands before an opening delimiter names its kind, by a table of
rules for each language (`KINDS`): the braces after `impl ... for ...` in Rust, the brackets after `import` in Go. In Python the
part of a parameter from its colon to the next comma or equals sign, and that from `->` to the colon, is a `type`.

Captures are strings, and names behind a word that defines them (`CAPTURES`). `WITHOUT` names the kinds that a capture may not have
around it; the check is an anti-join on the document, over the few intervals of such kinds, which travel as an array.

Everything is built-in expressions and windows by document. A delimiter without its partner closes at the end of the text. Comments
that nest are not followed. Null and empty texts, and languages without rules, have no captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Comments by family; strings and signs are those of all.
COMMENTS = {"slashes": r"//[^\n]*|/\*[\s\S]*?\*/", "hash": r"#[^\n]*", "dashes": r"--[^\n]*", "none": r"/\*[\s\S]*?\*/"}
FAMILIES = {
    "Rust": "slashes", "Go": "slashes", "Java": "slashes", "Javascript": "slashes", "Typescript": "slashes", "Swift": "slashes", "Dart": "slashes", "Zig": "slashes", "C": "slashes", "Css": "none", "Lua": "dashes", "R": "hash", "Python": "hash",
}
STRINGS = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'|`[^`]*`"
SIGNS = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|->|[ \t\r]+|[\s\S]"
#: (language, kind, opening delimiter, what the statement has before it).
KINDS = (
    ("Rust", "trait_impl", "{", r"\bimpl\b[^=]*\bfor\b"), ("Rust", "attribute", "[", r"#!?$"), ("Go", "import", "(", r"\bimport\s*$"), ("Java", "annotation", "(", r"@[A-Za-z_.]+\s*$"), ("Swift", "annotation", "(", r"@[A-Za-z_]+\s*$"),
    ("Dart", "annotation", "(", r"@[A-Za-z_.]+\s*$"), ("Javascript", "require", "(", r"\b(require|import)\s*$"), ("Typescript", "require", "(", r"\b(require|import)\s*$"), ("Zig", "import", "(", r"@(import|cImport|embedFile)\s*$"), ("C", "asm", "(", r"\basm\s*(volatile\s*)?$"),
    ("Css", "url", "(", r"\burl\s*$"), ("Lua", "require", "(", r"\brequire\s*$"), ("R", "library", "(", r"\b(library|require|source)\s*$"), ("Python", "parameters", "(", r"\bdef\s+[A-Za-z_0-9]+\s*$"),
)
#: (language, tag, the word before the name); strings are captured in all.
CAPTURES = (
    ("Rust", "identifier.function", "fn"), ("Rust", "identifier.type", "struct"), ("Go", "identifier.function", "func"), ("Java", "identifier.type", "class"), ("Swift", "identifier.function", "func"), ("Dart", "identifier.type", "class"),
    ("Javascript", "identifier.function", "function"), ("Typescript", "identifier.function", "function"), ("Zig", "identifier.function", "fn"), ("C", "identifier.type", "struct"), ("Lua", "identifier.function", "function"), ("Python", "identifier.function", "def"), ("Python", "identifier.type", "class"),
)
#: (language, tag, kinds that it may not be in).
WITHOUT = (
    ("Rust", "identifier.function", ("trait_impl",)), ("Rust", "string", ("attribute",)), ("Go", "string", ("import",)), ("Java", "string", ("annotation",)), ("Swift", "string", ("annotation",)), ("Dart", "string", ("annotation",)),
    ("Javascript", "string", ("require",)), ("Typescript", "string", ("require",)), ("Zig", "string", ("import",)), ("C", "string", ("asm",)), ("Css", "string", ("url",)), ("Lua", "string", ("require",)), ("R", "string", ("library",)), ("Python", "string", ("type",)),
)
#: Tokens before an opening delimiter that are looked at.
BEFORE = 60


def token_pattern(family: str) -> str:
    return f"{COMMENTS[family]}|{STRINGS}|{SIGNS}"


def token_rows(docs: DataFrame, key: str, text: str = "text", language: str = "language") -> DataFrame:
    """(key, language, k, token, start, end): all of a text in order, with byte offsets."""
    cut = None
    for name, family in FAMILIES.items():
        found = F.regexp_extract_all(F.col(text), F.lit(f"({token_pattern(family)})"), 1)
        cut = F.when(F.col(language) == name, found) if cut is None else cut.when(F.col(language) == name, found)
    rows = docs.where(F.col(text).isNotNull() & F.col(language).isin(*FAMILIES)).select(F.col(key).alias("doc"), F.col(language).alias("language"), F.posexplode(cut).alias("k", "token"))
    size = F.octet_length("token").cast("long")
    end = F.sum(size).over(Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - size)


def intervals(tokens: DataFrame) -> DataFrame:
    """(doc, kind, start, end, depth) of the blocks that a rule names, and of Python's types."""
    token = F.col("token")
    opens, closes = token.isin("{", "(", "["), token.isin("}", ")", "]")
    order = Window.partitionBy("doc").orderBy("k")
    run = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    head = F.array_join(F.collect_list("token").over(order.rowsBetween(-BEFORE, -1)), "")
    rows = tokens.withColumn("run", run).withColumn("head", F.when(opens, F.regexp_extract(head, r"[^;{}]*$", 0)))
    rows = rows.withColumn("last", F.max("end").over(Window.partitionBy("doc")))
    # A delimiter's depth is that of what it encloses.
    rows = rows.withColumn("depth", F.when(closes, F.col("run") + 1).otherwise(F.col("run")))
    kind = None
    for language, name, opening, before in KINDS:
        here = (F.col("language") == language) & (token == opening) & F.col("head").rlike(before)
        kind = F.when(here, name) if kind is None else kind.when(here, name)
    rows = rows.withColumn("kind", kind)
    level = Window.partitionBy("doc", "depth").orderBy("k")
    later = level.rowsBetween(1, Window.unboundedFollowing)
    first_after = lambda there: F.min(F.when(there, F.struct("k", "start", "end"))).over(later)
    within = F.last(F.when(opens, F.coalesce("kind", F.lit("")))  , ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("close", first_after(closes)).withColumn("stop", first_after(token.isin(",", "=") | closes)).withColumn("colon", first_after(token == ":")).withColumn("within", within)
    blocks = rows.where("kind IS NOT NULL").select("doc", "kind", "start", F.coalesce("close.end", "last").alias("end"), "depth")
    python = rows.where(F.col("language") == "Python")
    given = python.where((token == ":") & (F.col("within") == "parameters") & (F.col("depth") > 0)).select("doc", F.lit("type").alias("kind"), "start", F.coalesce("stop.start", "last").alias("end"), "depth")
    returned = python.where(token == "->").select("doc", F.lit("type").alias("kind"), "start", F.coalesce("colon.start", "last").alias("end"), "depth")
    return blocks.unionByName(given).unionByName(returned)


def captures(tokens: DataFrame) -> DataFrame:
    """(doc, language, tag, start, end) of strings, without their quotes, and of names that are defined."""
    plain = tokens.where(~F.col("token").rlike(r"^(\s+|//[\s\S]*|/\*[\s\S]*|--[\s\S]+)$") & ~((F.col("language").isin("R", "Python")) & F.col("token").startswith("#")))
    before = F.lag("token").over(Window.partitionBy("doc").orderBy("k"))
    rows = plain.withColumn("before", before)
    quoted = F.col("token").rlike("^[\"'`]") & (F.length("token") > 2)
    tag = F.when(quoted, "string")
    for language, name, word in CAPTURES:
        tag = tag.when((F.col("language") == language) & (F.col("before") == word) & F.col("token").rlike("^[A-Za-z_]"), name)
    shift = F.when(F.col("tag") == "string", 1).otherwise(0)
    return rows.withColumn("tag", tag).where("tag IS NOT NULL").select("doc", "language", "tag", (F.col("start") + shift).alias("start"), (F.col("end") - shift).alias("end"))


def forbidden_kinds() -> Column:
    """The kinds that a capture may not have around it, by language and tag."""
    out = None
    for language, tag, kinds in WITHOUT:
        here, value = (F.col("language") == language) & (F.col("tag") == tag), F.array(*[F.lit(k) for k in kinds])
        out = F.when(here, value) if out is None else out.when(here, value)
    return F.coalesce(out, F.array().cast("array<string>"))


def kept_captures(docs: DataFrame, key: str, text: str = "text", language: str = "language") -> DataFrame:
    """(key, tag, start_byte, end_byte) of the captures of each source without those that have a forbidden ancestor."""
    tokens = token_rows(docs, key, text, language)
    around = intervals(tokens).where(F.col("kind").isin(*{k for *_, kinds in WITHOUT for k in kinds}))
    by_doc = around.groupBy("doc").agg(F.collect_list(F.struct("kind", "start", "end")).alias("around"))
    found = captures(tokens).withColumn("no", forbidden_kinds()).join(by_doc, "doc", "left")
    inside = F.exists("around", lambda r: F.array_contains(F.col("no"), r["kind"]) & (r["start"] <= F.col("start")) & (F.col("end") <= r["end"]))
    return found.where(~F.coalesce(inside, F.lit(False))).select(F.col("doc").alias(key), "tag", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def one(spark: SparkSession, text: str, language: str) -> list[tuple[str, str]]:
    """(tag, captured text) of one source in order, for a look at a rule."""
    found = kept_captures(spark.createDataFrame([(1, text, language)], "id long, text string, language string"), "id").orderBy("start_byte").collect()
    return [(r["tag"], text.encode()[r["start_byte"] : r["end_byte"]].decode()) for r in found]
