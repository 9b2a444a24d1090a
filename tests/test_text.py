"""Words, identifiers, ranges and coordinates, on columns and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.variants import german_variants, python_variants
from quillspark.operators import ranges, tokens


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))


def column(spark, items, build):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string")
    return [r.y for r in df.select("k", build(F.col("x")).alias("y")).orderBy("k").collect()]


SPLITS = {
    "calculateUser_Age____word__": [("calculate", 0), ("User", 9), ("Age", 14), ("word", 21)], "XMLHttpRequest": [("XML", 0), ("Http", 3), ("Request", 7)], "userAge10": [("user", 0), ("Age", 4), ("10", 7)],
    "HTTPServer2Go": [("HTTP", 0), ("Server", 4), ("2", 10), ("Go", 11)], "": [], "___": [], "a.b:c": [("a", 0), ("b", 2), ("c", 4)], "élanVital": [("élan", 0), ("Vital", 4)],
}


def test_identifiers(spark):
    for word, want in SPLITS.items():
        assert [(p, a) for a, p in tokens.parts(word)] == want
    assert column(spark, list(SPLITS), X.split_identifier) == [[p for p, _ in want] for want in SPLITS.values()]


def test_identifier_columns_agree_with_python_on_random_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abzABZ019_.:éÉ") for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert column(spark, words, X.split_identifier) == [[p for _, p in tokens.parts(w)] for w in words]


def test_folding(spark):
    pairs = [("Straße", "STRASSE"), ("Σίγμας", "ΣΊΓΜΑΣ"), ("Привет", "ПРИВЕТ"), ("word", "WoRd")]
    left, right = column(spark, [a for a, _ in pairs], X.fold_key), column(spark, [b for _, b in pairs], X.fold_key)
    assert left == right


def test_word_classes(spark):
    assert column(spark, ["ABC", "abc", "Abc", "aBc", "Élan"], X.word_case) == ["all_caps", "all_lower", "title", "unknown", "title"]
    assert column(spark, ["München", "日本", "한국x", "ไทย", "Привет"], X.in_spaceless_script) == [False, True, True, True, False]
    assert column(spark, ["a1", "²", "Ⅳ", "abc"], X.has_number) == [True, True, True, False]


def test_places(spark):
    text = "one\n😀é two\nthree"
    for word, line, col, col16 in (("one", 1, 1, 0), ("two", 2, 4, 4), ("three", 3, 1, 0)):
        at = len(text[: text.index(word)].encode())
        r = one(spark, t=text, at=at).select(X.line_col(F.col("t"), F.col("at")).alias("p"), X.utf16_line_col(F.col("t"), F.col("at")).alias("q"), X.at_bytes(F.col("t"), F.col("at"), F.col("at") + len(word)).alias("s")).first()
        assert (r.p.line, r.p.col, r.q.line, r.q.col, r.s) == (line, col, line - 1, col16, word)
    r = one(spark, t="a😀b", x=0).select(X.utf16_slice(F.col("t"), F.lit(1), F.lit(3)).alias("a"), X.utf16_slice(F.col("t"), F.lit(3), F.lit(99)).alias("b"), X.utf16_slice(F.col("t"), F.lit(9), F.lit(4)).alias("c"), X.nth_line(F.lit("x\ny"), F.lit(1)).alias("d"), X.nth_line(F.lit("x"), F.lit(5)).alias("e")).first()
    assert tuple(r) == ("😀", "b", "", "y", None)


def test_small_functions(spark):
    r = spark.range(1).select(
        X.back_off(F.lit(0)), X.back_off(F.lit(3)), X.back_off(F.lit(99)), X.env_flag(F.lit("FALSE")), X.env_flag(F.lit("1")), X.env_flag(F.lit(None).cast("string")),
        X.severity(F.lit("Error")), X.severity(F.lit("other")), F.unix_timestamp(X.http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT"))), X.recased(F.lit("Word"), F.lit("ABC")), X.recased(F.lit("Word"), F.lit("abc")), X.recased(F.lit("word"), F.lit("Abc")),
    ).first()
    assert tuple(r) == (30, 240, 3600, False, True, False, 1, 3, 784111777, "WORD", "word", "word")


def test_tags(spark):
    assert column(spark, ["comment", "comment.line", "commentary", "string"], lambda c: X.tag_checked(c, ["comment"], [])) == [True, True, False, False]
    assert column(spark, ["comment", "comment.line", "string"], lambda c: X.tag_checked(c, [], ["comment.line"])) == [True, False, True]


def test_german_variants(spark):
    words = ["buecher", "aeoe", "STRASSE", "aeoeueaeoe", "strasse", "AEpfel", "plain", "", "ssss", "aue"]
    assert column(spark, words, german_variants) == [python_variants(w) for w in words]
    assert python_variants("buecher") == ["bücher"] and python_variants("aeoe") == ["äoe", "aeö", "äö"] and python_variants("STRASSE") == [] and python_variants("aeoeueaeoe") == []


SKIPPED = [
    (0, "see https://a.b/c?d=e f", "https://a.b/c?d=e"), (1, "c #deadbeef x", "#deadbeef"), (2, "to a.b+c@x-y.org now", "a.b+c@x-y.org"), (3, "in /usr/lib now", " /usr/lib"), (3, "'./x/y' z", "'./x/y'"), (4, r"at C:\x\y z", r"C:\x\y"),
    (5, "id 123e4567-e89b-12d3-a456-426614174000.", "123e4567-e89b-12d3-a456-426614174000"), (6, "b QUJDREVGR0hJSktMTU5PUFFSUw== c", "QUJDREVGR0hJSktMTU5PUFFSUw=="), (7, "at deadbee1 ok", "deadbee1"), (8, "a [text](http://x) b", "[text](http://x)"), (9, "import 'pkg:a/b.c';", "'pkg:a/b.c'"),
]


@pytest.mark.parametrize("index, text, want", SKIPPED)
def test_default_patterns(index, text, want):
    (pattern,) = ranges.compiled((ranges.DEFAULT_SKIP[index],))
    assert pattern.search(text)[0] == want


def test_what_default_patterns_leave():
    for index, text in ((3, "and/or"), (7, "acceded defaced"), (7, "abc12"), (6, "QUJDREVGR0hJSktMTU5PUFFSUw"), (1, "#12")):
        assert not ranges.compiled((ranges.DEFAULT_SKIP[index],))[0].search(text)


def test_scan_and_merge_against_sets(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        rows.append((k, [(a := rng.randrange(40), a + rng.randrange(1, 9)) for _ in range(rng.randrange(7))]))
    df = spark.createDataFrame([(k, [{"start_byte": a, "end_byte": b} for a, b in r]) for k, r in rows], "k int, r array<struct<start_byte:bigint,end_byte:bigint>>")
    got = {r.k: [tuple(x) for x in r.m] for r in df.select("k", ranges.merged(F.col("r")).alias("m")).collect()}
    flat = df.select("k", F.inline("r"))
    by_window = {}
    for r in ranges.islands(flat, ["k"], "start_byte", "end_byte").collect():
        by_window.setdefault(r.k, []).append((r.start_byte, r.end_byte))
    for k, r in rows:
        want = []
        for a, b in sorted(r):
            if want and a <= want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], b))
            else:
                want.append((a, b))
        assert got[k] == want and sorted(by_window.get(k, [])) == want
    assert ranges.scan("é a@b.cc https://x", ranges.DEFAULT_SKIP) == [(3, 9), (10, 19)]
    assert ranges.scan("", ranges.DEFAULT_SKIP) == []


def words_of(spark, text, **more):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [tuple(r)[1:] for r in tokens.token_rows(df, "text", more.get("skip", ranges.skip_ranges(F.col("text"), user=more.get("user", ()))), ["doc_id"]).collect()]


def test_tokens_with_ranges(spark):
    raw = "©<div>badword</div> HelloWorld calc_wrld I'm 1000\u202fkWh a\u00a0b 日本語abc x1y"
    got = words_of(spark, raw)
    assert all(raw.encode()[a:b].decode() == w for w, a, b in got)
    names = [w for w, _, _ in got]
    assert ("badword", 7, 14) in got and {"Hello", "World", "calc", "wrld", "I'm", "k", "Wh", "a", "b"} <= set(names) and not any("日" in w for w in names)
    assert [w for w, _, _ in words_of(spark, "vim.opt.foo bar", user=(r"vim\.opt\.[a-z]+",))] == ["bar"]
    assert words_of(spark, "") == [] and words_of(spark, None) == []


def test_containment_join(spark):
    items = spark.createDataFrame([(1, 0, 5), (1, 4, 6), (2, 0, 5)], "d long, start_byte long, end_byte long")
    inside = spark.createDataFrame([(1, 0, 5), (1, 5, 9)], "d long, start_byte long, end_byte long")
    assert sorted(map(tuple, ranges.outside_join(items, inside, "d").collect())) == [(1, 4, 6), (2, 0, 5)]
