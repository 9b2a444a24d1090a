"""Settings: parsing, merging, overrides, globs, files."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans import policy as P
from quillspark.plans import registry as R


@pytest.mark.parametrize("glob, path, hit", [("**/*.md", "a/b.md", True), ("**/*.md", "b.md", True), ("src/*", "src/a/b", True), ("src/?.c", "src/a.c", True), ("[ab].txt", "b.txt", True), ("[!ab].txt", "b.txt", False), ("a.c", "abc", False), ("docs/**", "docs/x/y", True), ("docs/**", "doc", False), ("{a,b}", "a", False)])
def test_globs(spark, glob, path, hit):
    assert P.glob_matches(glob, path) is hit
    assert spark.range(1).select(P.path_matches(F.lit(path), (glob,))).first()[0] is hit


def test_bad_globs_and_patterns_fail_at_parse():
    for text in ('ignore_patterns = ["("]', '[[overrides]]\npaths = ["a**"]\nwords = ["x"]', "words = 3", "not toml", "min_word_length = -1"):
        with pytest.raises(P.SettingsError):
            P.parse(text)
    assert not P.glob_matches("a**", "a")


def test_parse_and_render_round_trip():
    s = P.parse('dictionaries = ["EN_us"]\nwords = ["Foo", "q\\"x"]\nmin_word_length = 3\nuse_global = false\n[[overrides]]\npaths = ["**/*.md"]\nextra_words = ["BAR"]\n[[overrides]]\nwords = ["no paths"]\n[[overrides]]\npaths = ["x"]\n')
    assert s.dictionaries == ("en_us",) and s.words == ("Foo", 'q"x') and len(s.overrides) == 1 and s.overrides[0].extra_words == ("bar",)
    assert P.parse(P.render(s)) == s and P.render(P.Settings()) == ""


def test_merge():
    a = P.Settings(words=("b", "A"), min_word_length=5, ignore_patterns=("x",), use_global=True, overrides=(P.Override(("p",), words=()),))
    b = P.Settings(words=("a", "c"), min_word_length=3, ignore_patterns=("x",), use_global=False, overrides=(P.Override(("q",), words=("z",)),))
    m = a.merged(b)
    assert m.words == ("A", "b", "c") and m.min_length() == 3 and m.ignore_patterns == ("x", "x") and m.use_global and [o.paths for o in m.overrides] == [("p",), ("q",)]
    assert a.merged(P.Settings()).min_length() == 5 and P.Settings().min_length() == 3 and P.Settings().dictionary_ids() == ("en_us",)


def test_overrides(spark):
    s = P.Settings(words=("w",), flag_words=("f",), overrides=(P.Override(("*.md",), words=("a",), extra_words=("b",)), P.Override(("**/x.md",), extra_words=("c",)), P.Override(("*.py",), flag_words=(), dictionaries=("de",))))
    assert s.resolved("t/x.md").words == ("a", "b", "c") and s.resolved("t/x.md").overrides == () and s.resolved("y.py").flag_words == () and s.resolved("none") .words == ("w",)
    paths = ["t/x.md", "y.py", "none", "z.md"]
    got = {r.path: r for r in P.resolved_lists(spark.createDataFrame([(p,) for p in paths], "path string"), s).collect()}
    for p in paths:
        assert all(tuple(got[p][n]) == getattr(s.resolved(p), n) for n in P.LISTS)
    assert s.all_dictionary_ids() == ("de", "en_us")
    assert P.overrides_table(spark, s).count() == 3


def test_paths_tags_and_words():
    s = P.Settings(ignore_paths=("a/**",), include_paths=("a/b", "c"), words=("Straße",), flag_words=("TODO",), include_tags=("comment", "string"), exclude_tags=("comment.line",))
    assert s.ignores("a/b") and s.includes("a/b") and not s.includes("d") and s.allows("STRASSE") and s.flags("todo")
    assert s.checks_tag("comment.block") and not s.checks_tag("comment.line") and not s.checks_tag("identifier") and s.checks_tag("string")


def test_files(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    root = tmp_path / "project" / "deep"
    root.mkdir(parents=True)
    (tmp_path / "project" / "quillspark.toml").write_text('words = ["one"]\n')
    policy = P.Policy(root)
    assert policy.snapshot.words == ("one",)
    assert policy.add("words", "Two") and not policy.add("words", "tWO") and policy.add("words", "glob", everywhere=True)
    assert policy.snapshot.words == ("glob", "one", "Two") and not policy.reload()
    (tmp_path / "project" / "quillspark.toml").write_text("words = [")
    assert not policy.reload() and policy.snapshot.words == ("glob", "one", "Two") and len(policy.project.errors) == 1
    assert not policy.reload() and len(policy.project.errors) == 1
    (tmp_path / "project" / "quillspark.toml").unlink()
    assert policy.reload() and policy.snapshot.words == ("glob",)
    assert P.expand_home("~x") == "~x" and P.expand_home("~/a").endswith("/a")


def test_languages(spark):
    ids = {"rust": "Rust", "hs": "Haskell", "haskell": "Text", "shell script": "Bash", "vue": "HTML", "py": "Python", None: "Text"}
    paths = {"a/b.RS": "Text", "x.rs": "Rust", "Justfile": "Just", "a\\b.py": "Python", "r.R": "R", "noext": "Text", ".bashrc": "Text", "x.tar.md": "Markdown", "": "Text"}
    assert {k: R.language_of_id(k) for k in ids} == ids and {k: R.language_of_path(k) for k in paths} == paths
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r.p: r.l for r in df.select("p", R.of_path(F.col("p")).alias("l")).collect()} == paths
    assert spark.range(1).select(R.resolve(F.lit("haskell"), F.lit("a.rs"))).first()[0] == "Text" and spark.range(1).select(R.resolve(F.lit(None).cast("string"), F.lit("a.rs"))).first()[0] == "Rust"
    assert len(R.LANGUAGES) == 32 and len(R.AFFIX_IDS) == 28 and len(R.LIST_IDS) == 7
    names = [n for x in R.LANGUAGES for n in x.ids]
    assert len(names) == len(set(names))
    got = {(r.k, r.dictionary) for r in R.dictionaries_for(spark.createDataFrame([(1, "Rust"), (2, "Text")], "k int, language string"), ("en_us", "nope")).collect()}
    assert got == {(k, d) for k in (1, 2) for d in ("en_us", "builtin", "software_terms", "computing_acronyms")} | {(1, "rust")}
