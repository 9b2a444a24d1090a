"""Lexicons, checks, suggestions, reports, sources, sessions and the engine as a whole."""

import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import cli, queries, schema
from quillspark.operators import check, compounds, lexicon, ranges, report, suggest, tokens
from quillspark.plans.engine import Engine
from quillspark.plans.policy import Override, Settings
from quillspark.sources import files, resources
from quillspark.streaming import sessions

AFF = """SET UTF-8
TRY esianr
REP 1
REP f ph
NOSUGGEST !
ONLYINCOMPOUND c
COMPOUNDMIN 1
COMPOUNDRULE 1
COMPOUNDRULE n*t
PFX A Y 1
PFX A 0 re .
SFX D Y 3
SFX D 0 d e
SFX D y ied [^aeiou]y
SFX D 0 ed [^ey]
SFX S N 1
SFX S 0 s [^s]
"""


def test_affixes(spark, tmp_path):
    rules = lexicon.parse_affixes(AFF)
    assert lexicon.expand(rules, "create", ["A", "D"]) == {"create", "created", "recreate", "recreated"}
    assert lexicon.expand(rules, "try", ["D", "S"]) == {"try", "tried", "trys"}
    assert lexicon.expand(rules, "stem", ["A", "S"]) == {"stem", "stems", "restem"}
    assert lexicon.expand(rules, "th", ["c", "S"]) == {"ths"} and rules.compounds == ["n*t"] and rules.replacements == [("f", "ph")] and rules.compound_min == 1
    (tmp_path / "en.aff").write_text(AFF)
    (tmp_path / "en.dic").write_text("4\ncreate/AD\nParis\nrude/!S\n\n")
    rows = {(r.word, r.suggested) for r in lexicon.read_affix_dictionary(spark, f"file://{tmp_path}/en.aff", f"file://{tmp_path}/en.dic", "en").collect()}
    assert rows == {(w, True) for w in ("create", "created", "recreate", "recreated", "Paris")} | {("rude", False), ("rudes", False)}
    with pytest.raises(ValueError):
        lexicon.parse_affixes("SFX Q 0 s .")


GERMAN = """COMPOUNDBEGIN x
COMPOUNDMIDDLE y
COMPOUNDEND z
COMPOUNDPERMITFLAG c
ONLYINCOMPOUND o
COMPOUNDMIN 3
SFX N Y 1
SFX N 0 n .
SFX j Y 1
SFX j 0 s/xyoc .
"""


def test_compound_parts(spark):
    rules = lexicon.parse_affixes(GERMAN)
    assert lexicon.expand(rules, "arbeit", ["j"]) == {"arbeit"}
    assert lexicon.forms(rules, "arbeit", ["j", "z"]) == {"arbeit": {"last"}, "arbeits": {"last", "first", "inner"}}
    assert lexicon.forms(rules, "suche", ["N", "x", "z"]) == {"suche": {"first", "last"}, "suchen": {"last"}}
    lines = spark.createDataFrame([("Arbeit/jz",), ("Platz/xyz",), ("Suche/Nz",), ("ab/xyz",), ("frei",), ("",), ("Platz/z",)], "value string")
    known = compounds.parts(lines, rules, "de")
    rows = {(r.part, r.first, r.inner, r.last) for r in known.collect()}
    assert rows == {("arbeit", False, False, True), ("arbeits", True, True, True), ("platz", True, True, True), ("suche", False, False, True), ("suchen", False, False, True)}
    ask = ["Arbeitsplatz", "Arbeitsplatzsuche", "Arbeitplatz", "Platzfrei", "Platzsucheplatz", "platzplatzplatz", "Platz", "abplatz", "", "arbeits", "platz" * 300, "platz" * 300 + "x"]
    words = spark.createDataFrame([(w, w.lower()) for w in ask * 2], "word string, fold_key string")
    assert {r.word for r in compounds.known_compounds(words, known).collect()} == {"Arbeitsplatz", "Arbeitsplatzsuche", "platzplatzplatz", "platz" * 300}
    assert compounds.known_compounds(words, known.limit(0)).count() == 0 and compounds.known_compounds(words.limit(0), known).count() == 0
    two = known.where("part = 'arbeits'").unionByName(known.where("part = 'platz'").withColumn("dictionary", F.lit("other")))
    assert compounds.known_compounds(words, two).where("word = 'Arbeitsplatz'").count() == 0  # parts of two dictionaries make no word


def test_an_engine_knows_compounds(spark, tmp_path):
    (tmp_path / "de.aff").write_text(GERMAN)
    (tmp_path / "de.dic").write_text("3\nArbeit/jz\nPlatz/xyz\nSuche/Nz\n")
    engine = Engine(spark, Settings(dictionaries=("de",)), local_dir=str(tmp_path))
    found = engine.spell_check_text("Arbeitsplatz Arbeitplatz Platz Arbeitsplatzsuche Platzz", "text")
    assert {r.word for r in found.collect()} == {"Arbeitplatz", "Platzz"}
    asked = spark.createDataFrame([("Arbeitsplatz",), ("Platzz",)], "word string")
    assert {r.word for r in engine.suggestions(asked).collect()} == {"Platzz"}
    engine.invalidate("de")
    assert not engine.parts


def test_word_lists(spark, tmp_path):
    (tmp_path / "own.txt").write_text("# head\nFoo\n\n bar\nfoo\n")
    got = lexicon.local_dictionary(spark, str(tmp_path), "own")
    assert sorted(r.word for r in got.collect()) == [" bar", "Foo", "foo"] and lexicon.local_dictionary(spark, str(tmp_path), "none") is None
    assert [r.word for r in lexicon.combined_list(spark.createDataFrame([("B",), ("a",), ("Ab",), ("ab",)], "word string")).collect()] == ["ab"]
    assert {r.word for r in lexicon.common_words(spark.createDataFrame([("fooBar_baz2 x-yz",)], "t string"), "t").collect()} == {"foobar", "baz", "yz"}


def rows_of(spark, text):
    return spark.createDataFrame([(1, w, k, k + 1) for k, w in enumerate(text.split())], "doc_id long, word string, start_byte long, end_byte long")


def test_findings(spark):
    lex = lexicon.from_words(spark, ["the", "Straße"], "d")
    got = {r.word: [tuple(x) for x in r.locations] for r in check.findings(rows_of(spark, "the Teh teh STRASSE ab to todo Allowd teh"), lex, flag=("TO", "the"), allow=("allowd",)).collect()}
    assert got == {"Teh": [(1, 2)], "teh": [(2, 3), (8, 9)], "to": [(5, 6)], "todo": [(6, 7)], "the": [(0, 1)]}
    german = lexicon.from_words(spark, ["Bücher"], "de")
    assert [r.word for r in check.findings(rows_of(spark, "buecher buechor"), german, german=german).collect()] == ["buechor"]
    assert check.findings(rows_of(spark, "xyz").limit(0), lex).count() == 0


def test_round_robin(spark):
    def merge(*sources, most=5):
        rows = [("w", s, k, x) for s, xs in enumerate(sources) for k, x in enumerate(xs)]
        df = spark.createDataFrame(rows, "word string, source int, rank int, item string")
        return suggest.round_robin(df, ["word"], most).first()["items"]

    assert merge("abc", "def", "ghk") == list("adgbe") and merge("ab", "acd") == list("abcd") and merge("abcdefg") == list("abcde")
    rng = random.Random(1)
    for _ in range(5):
        sources = [rng.sample("abcdefgh", rng.randrange(1, 6)) for _ in range(3)]
        want = list(dict.fromkeys(x for r in itertools.zip_longest(*sources) for x in r if x))[:4]
        assert merge(*sources, most=4) == want


def test_suggestions(spark):
    lex = lexicon.from_words(spark, ["hello", "help", "yellow", "Halo", "world"], "d").unionByName(lexicon.from_words(spark, ["hell", "hello"], "e"))
    got = {r.word: r.suggestions for r in suggest.suggestions(spark.createDataFrame([("helo",), ("HELO",), ("world",), ("zzzzzz",)], "word string"), lex, ["d", "e"]).collect()}
    assert got["helo"][:2] == ["halo", "hell"] or got["helo"][0] in ("halo", "hello", "help") and "hello" in got["helo"]
    assert all(x == x.upper() for x in got["HELO"]) and "world" not in got and "zzzzzz" not in got
    german = lexicon.from_words(spark, ["Bücher", "Büchse"], "de")
    hits = {r.word: r.suggestions for r in suggest.german_suggestions(spark.createDataFrame([("buechr",), ("Buecher",)], "word string"), german).collect()}
    assert hits["Buecher"][0] == "Bücher" and "bücher" in [x.lower() for x in hits["buechr"]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_ranked_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))

    def changed(w):
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:at] + (rng.choice("abcd") if kind else "") + w[at + (kind != 1) :]
        return w or "d"

    known = {word(rng.choice((1, 2, 3, 4, 7, 9, 17, 18, 19, 20, 21, 22, 23, 24, 40))) for _ in range(150)} | {"abcd", "cab"}
    asked = {changed(w) for w in known for _ in range(2)} | {"axyd", "zcabz"}
    lex = lexicon.from_words(spark, sorted(known), "d")
    got = suggest.ranked(spark.createDataFrame([(w,) for w in asked], "word string"), lex, distance=distance, most=1000)
    want = set()
    for w in asked:
        near = sorted((d, abs(len(w) - len(k)), k) for k in known if 0 < (d := edits(w, k)) <= distance)
        want |= {(w, rank, k) for rank, (_, _, k) in enumerate(near, 1)}
    assert {(r.word, r.rank, r.suggestion) for r in got.collect()} == want and len(want) > 100


def test_suggestions_for_all_unknown_words_of_documents(spark, tmp_path):
    known = ["hello", "help", "world", "abcd", "stone"]
    unknown = {1: "helo wrlod axyd", 2: "stoooe Hlelo zzzzzzz", 3: "HELPPP stne"}
    rows = [(k, " ".join(known), "en") for k in range(10, 10 + queries.LEAST_DOCS)] + [(k, x, "en") for k, x in unknown.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for w in " ".join(unknown.values()).split():
        near = sorted((d, abs(len(w) - len(k)), k) for k in known if (d := edits(w.lower(), k)) <= 2)
        want |= {(w, rank, k.upper() if w.isupper() else k) for rank, (_, _, k) in enumerate(near[: suggest.MOST], 1)}
    got = {(r.word, r.rank, r.suggestion.lower() if r.word == "Hlelo" else r.suggestion) for r in queries.QUERIES["suggest_documents"](spark, str(tmp_path)).collect()}
    assert got == want and {w for w, _, _ in want} >= {"axyd", "stoooe", "HELPPP", "Hlelo"}


def test_reports(spark):
    docs = spark.createDataFrame([(1, "./b.txt", "one\nteh é teh"), (2, "a.txt", "teh Teh")], "doc_id long, path string, text string")
    bad = spark.createDataFrame([(1, "teh", [(4, 7), (11, 14)]), (2, "teh", [(0, 3)]), (2, "Teh", [(4, 7)])], "doc_id long, word string, locations array<struct<start_byte:bigint,end_byte:bigint>>")
    places = report.placed(bad, docs, "doc_id").drop("doc_id")
    assert sorted((r.path, r.line, r.col) for r in places.collect()) == [("./b.txt", 2, 1), ("./b.txt", 2, 7), ("a.txt", 1, 1), ("a.txt", 1, 5)]
    assert [(r.path, r.word) for r in report.first_only(places).collect()] == [("./b.txt", "teh")]
    hints = spark.createDataFrame([("teh", ["the", "ten"])], "word string, suggestions array<string>")
    assert {r.value for r in report.lines(places, suggestions=hints).collect()} == {"  b.txt:2:1  teh  -> the, ten", "  b.txt:2:7  teh  -> the, ten", "  a.txt:1:1  teh  -> the, ten", "  a.txt:1:5  Teh"}
    state = spark.createDataFrame([("./b.txt", "checked"), ("a.txt", "checked"), ("i", "ignored"), ("x", "excluded")], "path string, state string")
    assert tuple(report.summary(state, places).select("total", "checked", "ignored", "excluded", "errors", "files_with_errors", "status").first()) == (4, 2, 1, 1, 4, 2, 1)
    assert report.summary(state, places.limit(0)).first().status == 0 and report.summary(state.withColumn("state", F.lit("failed")), places).first().status == 2
    d = report.diagnostics(bad, docs, "doc_id", "warning").where("start_line = 1").orderBy("start_col").collect()
    assert [(r.start_col, r.end_col, r.severity) for r in d] == [(0, 3, 2), (6, 9, 2)]
    assert [r.word for r in report.ordered(bad.where("doc_id = 2"), "doc_id").collect()] == ["teh", "Teh"]


def test_quick_fixes(spark):
    places = spark.createDataFrame([("teh", 1), ("xx", 2)], "word string, at int")
    hints = spark.createDataFrame([("teh", list("abcdefg"))], "word string, suggestions array<string>")
    got = {r.word: [(a.action, a.text) for a in r.actions] for r in report.quick_fixes(places, hints).collect()}
    adds = lambda w: [("add_to_project", w), ("add_to_global", w)]
    assert got == {"teh": [("replace", x) for x in "abcde"] + adds("teh"), "xx": adds("xx")}


def test_written_report(spark, tmp_path):
    lines = spark.createDataFrame([("b", 5, "  b:2"), ("a", 0, "  a:1"), ("b", 1, "  b:1")], "path string, start_byte long, value string")
    report.write_report(lines, f"file://{tmp_path}/r")
    assert "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))) == "a\n  a:1\nb\n  b:1\n  b:2\n"


def tree(root):
    for name, text in {"a.txt": "the teh", "sub/b.rs": 'fn fooo() { let the = "teh"; }', "sub/skip.log": "teh", ".hidden": "teh", "sub/deep/c.md": "# Teh the", "sub/.gitignore": "*.log\n/deep/x\n", "sub/deep/x": "teh"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bin").write_bytes(b"\xff\xfe\x00teh")
    (root / "link").symlink_to(root / "a.txt")


def test_paths(tmp_path):
    tree(tmp_path)
    short = lambda found: [p.removeprefix(f"{tmp_path}/") for p in found[0]]
    assert short(files.resolve_paths(["."], tmp_path)) == ["a.txt", "bin", "sub/b.rs", "sub/deep/c.md"]
    assert short(files.resolve_paths(["**/*.md", "a.txt", "sub"], tmp_path)) == ["a.txt", "sub/b.rs", "sub/deep/c.md"]
    assert files.resolve_paths(["*.none"], tmp_path) == ([], True) and files.resolve_paths(["a**"], tmp_path)[1]
    for line, path, want in (("*.log", "x/y.log", True), ("/a", "b/a", False), ("a/b", "a/b", True), ("d/", "d", False), ("**/z", "q/z", True)):
        pattern, _, only_dirs = files.ignore_rule(line, "")
        assert (bool(pattern.match(path)) and not only_dirs) is want
    assert files.ignore_rule("# c", "") is None


def engine(spark, settings=None):
    e = Engine(spark, settings or Settings())
    e.add_lexicon("base", lexicon.from_words(spark, ["the", "fn"], "base"), primary=True)
    return e


def test_lint(spark, tmp_path):
    tree(tmp_path)
    e = engine(spark, Settings(ignore_paths=("sub/deep/**",)))
    lines, summary = e.lint(["."], tmp_path)
    assert {r.value.strip() for r in lines.collect()} == {"a.txt:1:5  teh", "sub/b.rs:1:4   fooo", "sub/b.rs:1:24  teh"}
    assert tuple(summary.select("total", "checked", "ignored", "errors", "status").first()) == (4, 3, 1, 3, 1)
    lines, summary = e.lint(["."], tmp_path, unique=True, suggesting=True)
    assert {r.value.strip() for r in lines.collect()} == {"a.txt:1:5  teh  -> the", "sub/b.rs:1:4  fooo"} and summary.first().errors == 2
    assert e.lint(["nothing*"], tmp_path)[1].first().status == 2


def test_engine(spark):
    e = engine(spark, Settings(overrides=(Override(("*.md",), extra_words=("wolrd",)), Override(("x.md",), extra_flag_words=("the",)))))
    docs = spark.createDataFrame([(1, "a.txt", None, "the wolrd Wolrd"), (2, "a.md", None, "the wolrd"), (3, "x.md", None, "the wolrd"), (4, None, "python", "teh = 1  # the cmt"), (5, None, "unknwn", "teh"), (6, "n.txt", None, None)], "doc_id long, path string, language string, text string")
    got = {(r.doc_id, r.word) for r in e.spell_check(docs).collect()}
    assert got == {(1, "wolrd"), (1, "Wolrd"), (3, "the"), (4, "teh"), (4, "cmt"), (5, "teh")}
    assert [(r.word, [tuple(x) for x in r.locations]) for r in e.spell_check_text("©<div>badword</div>", "html").collect()] == [("badword", [(7, 14)])]
    bare = Engine(spark, Settings())
    assert bare.spell_check(docs).count() == 0 and not bare.warm()["available"] and bare.suggestions(spark.createDataFrame([("x",)], "word string")).count() == 0
    e.add_lexicon("rust", lexicon.from_words(spark, ["usize"], "rust"))
    langs = spark.createDataFrame([(1, "a.rs", None, 'let usize = "usize";'), (2, "a.txt", None, "usize")], docs.schema)
    assert [(r.doc_id, r.word) for r in e.spell_check(langs).collect()] == [(2, "usize")]
    assert e.ensure("nope") == "unavailable" and e.ensure("rust") == "fresh"
    e.invalidate("rust")
    assert "rust" not in e.lexicons and "rust" in e.wanted()


def test_command_line(tmp_path, monkeypatch, capsys, spark):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.txt").write_text("the teh")
    (tmp_path / "words").write_text("the\n")
    run = lambda *a: cli.main(["--root", str(root), *a])
    assert run("lint", "--lexicon", str(tmp_path / "words"), "a.txt") == 1 and "a.txt:1:5  teh" in capsys.readouterr().out
    assert run("add", "Teh") == 0 and run("lint", "--lexicon", str(tmp_path / "words"), "a.txt") == 0
    assert run("lint", "a.txt") == 2 and run("regions", str(root / "a.txt")) == 0 and run("clean", "--cache", str(tmp_path / "none")) == 0


class Wire:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def get(self, url, since):
        self.asked.append((url, since))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_cache(tmp_path):
    now = [1000.0]
    R = resources.Response
    wire = Wire(R(200, b"one", "Mon"), R(304), R(200, b"two"), R(500), OSError("down"))
    cache = resources.Cache(tmp_path, wire, lambda: now[0], lambda s: None)
    path = cache.get("http://x/d.dic")
    assert path.read_bytes() == b"one" and cache.get("http://x/d.dic") == path and len(wire.asked) == 1
    now[0] += resources.FRESH_SECONDS + 1
    assert cache.get("http://x/d.dic").read_bytes() == b"one" and wire.asked[-1] == ("http://x/d.dic", "Mon")
    now[0] += resources.FRESH_SECONDS + 1
    assert cache.get("http://x/d.dic").read_bytes() == b"two"
    now[0] += resources.FRESH_SECONDS + 1
    assert cache.get("http://x/d.dic").read_bytes() == b"two"
    other = resources.Cache(tmp_path, None)
    assert other.local("http://x/d.dic") == path and other.clean() == 1 and not path.exists()
    cold = resources.Cache(tmp_path / "c", Wire(OSError("x"), R(503), R(200, b"ok")), lambda: 0.0, lambda s: None)
    assert cold.get("u").read_bytes() == b"ok"
    with pytest.raises(resources.ResourceError) as e:
        resources.Cache(tmp_path / "d", Wire(R(404)), lambda: 0.0, lambda s: None).get("u")
    assert e.value.permanent
    both = resources.Cache(tmp_path / "e", Wire(R(200, b"a"), R(200, b"b"), R(200, b"a2"), R(304), R(200, b"b2")), lambda: now[0])
    assert both.pair("a", "b") == "new" and both.pair("a", "b") == "fresh"
    now[0] += resources.FRESH_SECONDS + 1
    assert both.pair("a", "b") == "refreshed" and both.local("b").read_bytes() == b"b2"
    assert resources.network_off({"QUILLSPARK_OFFLINE": "1"}) and not resources.network_off({"QUILLSPARK_OFFLINE": "False"})


def test_back_off():
    b = resources.BackOff()
    assert [b.failed("x", 0.0) for _ in range(9)] == [30, 60, 120, 240, 480, 960, 1920, 3600, 3600]
    assert not b.ready("x", 10.0) and b.ready("x", 3600.0) and b.ready("y", 0.0) and b.next_wait(0.0) == 3600 and resources.BackOff().next_wait(0) == resources.IDLE_WAIT
    b.failed("gone", 0.0, permanent=True)
    b.kick()
    assert b.ready("x", 0.0) and not b.ready("gone", 1e9)

    def ensure(name):
        if name == "bad":
            raise resources.ResourceError("x", permanent=True)
        return "new" if name == "pair" else "fresh"

    assert resources.prefetch(["bad", "list"], ensure, b, 0.0) is False and resources.prefetch(["pair"], ensure, b, 0.0) is True and "bad" in b.gone


def test_a_failure_for_good_leaves_no_time_to_wait_for():
    b = resources.BackOff()
    assert b.failed("x", 0.0) == 30 and b.next_wait(1.0) == 29
    assert b.failed("x", 1.0, permanent=True) == 0 and b.next_wait(1.0) == resources.IDLE_WAIT and not b.ready("x", 1e9)
    assert b.failed("x", 2.0) == 60 and b.next_wait(2.0) == 60


def test_back_off_of_users_with_many_failures_in_a_row(spark, tmp_path):
    kinds = ["error"] * 23 + ["view"] + ["error"] * 11
    spark.createDataFrame([(k, u, x) for u in (1, 2) for k, x in enumerate(kinds[u - 1 :], 100 * u)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(queries.SQL["back_off_by_user"])
    columns = [c[0] for c in found.description]
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES["back_off_by_user"](spark, str(tmp_path)).collect()) == sorted(found.fetchall())


def test_intervals_that_an_order_has_twice_are_one_island(spark, tmp_path):
    rows = [(k, p, float(q)) for k in range(50) for p, q in ((2, 3), (9, 1), (9, 1), (10, 2), (20, 5), (20, 5), (25, 1))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("interval_merge", "interval_merge_arrays"):
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).select("l_orderkey", "start_byte", "end_byte").collect()))
        assert got == [(k, s, e) for k in range(50) for s, e in ((2, 5), (9, 12), (20, 26))]


def test_keys_of_known_words_are_joined_without_a_broadcast(spark, tmp_path):
    spark.createDataFrame([("corpus", "hausen", "hausen"), ("corpus", "maus", "maus")], "dictionary string, word string, fold_key string").write.parquet(f"{tmp_path}/lex")
    lex = spark.read.parquet(f"{tmp_path}/lex")
    found = suggest.ranked(spark.createDataFrame([("haus",), ("Mauss",)], "word string"), lex)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_cut" in plan and "BroadcastHashJoin [_cut" not in plan
    assert sorted((r.word, r["rank"], r.suggestion) for r in found.collect()) == [("Mauss", 1, "maus"), ("haus", 1, "maus"), ("haus", 2, "hausen")]
    keys = spark.range(0, suggest.BITS, 64 * suggest.ROW // 2).select(F.col("id").alias("_cut"))
    odd = keys.where("_cut % 1024 = 512").withColumn("_cut", F.col("_cut") + suggest.BITS)
    assert suggest._known_by_bits(keys, odd).agg(F.count("*"), F.min("_cut")).first() == (suggest.BITS // (64 * suggest.ROW), 512)


def test_texts_of_a_batch_are_objects_in_slices(spark, monkeypatch):
    seen = []

    @ranges.sliced
    def run(texts: pa.Array, more: pa.Array) -> pa.Array:
        seen.append(len(texts))
        return ranges.listed([[(len(t or ""), n)] for t, n in zip(texts.to_pylist(), more.to_pylist(), strict=True)], schema.RANGE)

    monkeypatch.setattr(ranges, "SLICE", 10)
    texts = ["abc", None, "é" * 30, "", "abcdef", "abcdefg", "x"]
    got = run(pa.array(texts), pa.array(range(7))).to_pylist()
    assert [(r["start_byte"], r["end_byte"]) for x in got for r in x] == [(len(t or ""), k) for k, t in enumerate(texts)]
    assert len(seen) > 2 and sum(seen) == 7 and run(pa.array([], pa.string()), pa.array([], pa.int64())).to_pylist() == []


@pytest.mark.parametrize("repeated", [False, True])
def test_words_are_counted_by_document(spark, tmp_path, repeated):
    texts = ["Alpha beta beta BETA zeta", "alpha gamma", None, "", "alpha beta", "Alpha", "ALPHA alpha", "alpha", "zeta zeta 12", "zeta"]
    rows = [(k // 2 if repeated else k, x, ("en", "de", None)[k % 3], "src0") for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("unknown_words", "flag_words_override", "german_unknown") + (() if repeated else ("findings_per_document",)):
        found = con.execute(queries.SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == sorted(found.fetchall(), key=repr)
    counts = queries.doc_counts(spark, str(tmp_path))
    # Words of documents that are one row each are not shuffled.
    assert repeated or "Exchange hashpartitioning(doc_id" not in counts._jdf.queryExecution().executedPlan().toString() and "inline" in counts._jdf.queryExecution().executedPlan().toString()


EVENTS = [("a", 1, "open", "x"), ("b", 1, "change", "not open"), ("a", 2, "change", "y"), ("c", 1, "open", "z"), ("a", 2, "save", "y2"), ("c", 2, "close", None), ("d", 1, "open", "q"), ("d", 2, "close", None), ("d", 3, "open", "again"), ("a", 3, "save", None)]


def test_sessions_in_a_batch(spark):
    rows = [(u, v, "Text", op, t, k) for k, (u, v, op, t) in enumerate(EVENTS)]
    df = spark.createDataFrame(rows, "uri string, version long, language_id string, op string, text string, seq long")
    got = {r.uri: (r.version, r.text) for r in sessions.current(df).collect()}
    state = {}
    for u, v, op, t in EVENTS:
        now = sessions.step(state.get(u), [{"version": v, "language_id": "Text", "op": op, "text": t}])
        state = {**{k: x for k, x in state.items() if k != u}, **({u: now} if now else {})}
    assert got == {u: (s[0], s[2]) for u, s in state.items()} == {"a": (2, "y2"), "d": (3, "again")}
    assert sessions.due(df, while_typing=False).count() == 2 and sessions.due(df).count() == 8
    late = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("c", 1, "closed")], "uri string, version long, finding string")
    assert [r.finding for r in sessions.still_current(late, sessions.current(df)).collect()] == ["new"]


def test_sessions_as_a_stream(spark, tmp_path):
    schema = "uri string, version long, language_id string, op string, text string"
    source = tmp_path / "events"
    batches = [[("a", 1, "Text", "open", "teh the"), ("b", 1, "Text", "open", "the")], [("a", 2, "Text", "change", "the teh teh")], [("a", 2, "Text", "close", None), ("b", 2, "Text", "change", "teh")]]
    lex, shown, published = lexicon.from_words(spark, ["the"], "d"), {}, []

    def find(docs):
        words = docs.select("uri", "version", F.explode(F.split("text", " ")).alias("word"), F.lit(0).cast("long").alias("start_byte"), F.lit(1).cast("long").alias("end_byte"))
        return check.findings(words, lex, "uri").join(docs.select("uri", "version"), "uri")

    def sink(docs, findings, batch):
        for r in docs.collect():
            shown[r.uri] = []
        for r in findings.collect():
            shown[r.uri].append((r.version, r.word))
        published.append({k: list(v) for k, v in shown.items()})

    reloads = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(schema).parquet(f"file://{source}")
        query = sessions.start(stream, sessions.Published(find, sink, lambda: bool(reloads.append(k))), f"file://{tmp_path}/check", {"availableNow": True})
        query.awaitTermination(120)
    assert published[0] == {"a": [(1, "teh")], "b": []} and published[1]["a"] == [(2, "teh")] and published[-1] == {"a": [], "b": [(2, "teh")]} and len(reloads) >= 3


def test_options(spark):
    r = spark.range(1).select(files.init_options(F.lit('{"checkWhileTyping": false, "diagnosticSeverity": "Hint"}')).alias("a"), files.init_options(F.lit("broken")).alias("b")).first()
    assert tuple(r.a) == (False, "hint", "info", None) and tuple(r.b) == (True, "information", "info", None)


def test_identifier_rows(spark):
    df = spark.createDataFrame([(1, "fooBar2baz")], "k int, x string")
    assert [(r.pos, r.part) for r in tokens.identifier_rows(df, "x", ["k"]).collect()] == [(0, "foo"), (1, "Bar"), (3, "baz")]


def test_an_engine_strips_affixes(spark, tmp_path):
    (tmp_path / "en_us.aff").write_text("FLAG UTF-8\nNEEDAFFIX n\nFORBIDDENWORD x\nKEEPCASE k\nSFX B Y 1\nSFX B 0 able/S .\nSFX S Y 1\nSFX S 0 s .\nCOMPOUNDMIN 1\nCOMPOUNDRULE 1\nCOMPOUNDRULE a*b\n")
    (tmp_path / "en_us.dic").write_text("8\ndrink/B\npseudo/nS\nParis\nwrong/xS\nkilo/k\nsun/a\nrain/a\nshine/b\n")
    engine = Engine(spark, local_dir=str(tmp_path))
    text = "drink drinkable drinkables drinks pseudo pseudos paris pARIS PARIS wrong wrongs kilo Kilo sunshine sunrainshine shinesun"
    assert {r.word for r in engine.spell_check_text(text).collect()} == {"drinks", "pseudo", "ARIS", "wrong", "wrongs", "Kilo", "shinesun"}
    got = {r.word: r.suggestions for r in engine.suggestions(spark.createDataFrame([("drinkible",), ("paris",)], "word string")).collect()}
    assert got["drinkible"][0] == "drinkable" and "paris" not in got


def test_first_words_equal_the_least_structures(spark):
    rng = random.Random(4)
    letters = ["a", "A", "bc", "Bc", "BC", "é", "É", "dd", "dD", ""]
    docs = [(rng.choice([None, "z/1", "z/2", "a/9", "m", "Z", ""]), [rng.choice(letters) for _ in range(rng.randint(0, 6))]) for _ in range(40)]
    df = spark.createDataFrame([*docs, ("z/1", None), (None, ["q"])], "path string, words array<string>").repartition(5)
    for least in (1, 2):
        rows = df.select("path", F.posexplode("words").alias("start_byte", "word")).where(F.char_length("word") >= least)
        found = report.first_words(df, least)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, report.first_only(rows).collect()), key=str) != []
    assert report.first_words(df.limit(0), 1).collect() == []
    # One aggregation sorts its rows: that of the words that are left.
    assert found._jdf.queryExecution().sparkPlan().toString().count("SortAggregate") == 2
