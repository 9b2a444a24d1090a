"""Regions by language; every region is where it says, and tags come from the closed vocabulary."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import capture
from quillspark.schema import TAGS

SAMPLES = {
    "Rust": ('/// doc\nfn fooBar(argOne: i32) { let valName = "strText"; }\nimpl A for B { fn hidden() {} }\nstruct Point { xField: i32 }\n/* blk */', {("comment.line", "/// doc"), ("identifier.function", "fooBar"), ("identifier.parameter", "argOne"), ("identifier.variable", "valName"), ("string", "strText"), ("identifier.type", "Point"), ("identifier.field", "xField"), ("comment.block", "/* blk */")}, {"hidden"}),
    "C": ('#define MAXV 3\nint addTwo(int left, char *right) { int total = left; return total; } // cmt\nchar *s = "str";', {("identifier.constant", "MAXV"), ("identifier.function", "addTwo"), ("identifier.parameter", "left"), ("identifier.variable", "total"), ("comment", "// cmt"), ("string", "str")}, set()),
    "Cpp": ('class Widget { };\nR"x(raw)x"; // c', {("identifier.type", "Widget"), ("string", "raw")}, set()),
    "CSharp": ('class Foo { public string Bar; void Run(int arg) { var loc = "s"; } }', {("identifier.type", "Foo"), ("identifier.field", "Bar"), ("identifier.function", "Run"), ("identifier.parameter", "arg"), ("identifier.variable", "loc"), ("string", "s")}, set()),
    "Java": ('class Foo { int calc(int arg) { String nam = "s"; return 1; } }', {("identifier.type", "Foo"), ("identifier.function", "calc"), ("identifier.parameter", "arg"), ("string", "s")}, {"return"}),
    "Dart": ("class Foo { void runIt(int arg) { var loc = 's'; } } // c", {("identifier.type", "Foo"), ("identifier.function", "runIt"), ("identifier.variable", "loc"), ("string", "s"), ("comment", "// c")}, set()),
    "Javascript": ("function fooBar(argA) { const valB = `t`; } class Baz {} // c\nuse(other)", {("identifier.function", "fooBar"), ("identifier.parameter", "argA"), ("identifier.variable", "valB"), ("string", "t"), ("identifier.type", "Baz"), ("comment", "// c")}, {"other", "use"}),
    "Typescript": ("interface Shape { sideLen: number }\nconst go = (first: string) => first", {("identifier.type", "Shape"), ("identifier.variable", "go"), ("identifier.parameter", "first")}, set()),
    "Tsx": ("const App = 1 /* c */", {("identifier.variable", "App"), ("comment", "/* c */")}, set()),
    "Css": (".boxName { border-width: thinly; } /* c */", {("identifier.type", "boxName"), ("identifier.field", "border-width"), ("identifier", "thinly"), ("comment", "/* c */")}, set()),
    "Elixir": ('defmodule Foo do\n  def barBaz(x) do\n    res = "s" # c\n  end\nend\n~s(sig)', {("identifier.type", "Foo"), ("identifier.function", "barBaz"), ("identifier.variable", "res"), ("string", "s"), ("comment", "# c"), ("string.special", "(sig)")}, set()),
    "Erlang": ('runIt(Arg) -> "s". % c', {("identifier.function", "runIt"), ("identifier.variable", "Arg"), ("string", "s"), ("comment", "% c")}, set()),
    "Go": ('package mainly\nfunc runIt(arg int) { locV := "s" } // c\ntype Foo struct {\n\tBar int\n}', {("identifier.module", "mainly"), ("identifier.function", "runIt"), ("identifier.parameter", "arg"), ("identifier.variable", "locV"), ("string", "s"), ("identifier.type", "Foo"), ("identifier.field", "Bar")}, set()),
    "Haskell": ('module Foo where\nbarBaz x = "s" -- c', {("identifier.module", "Foo"), ("identifier.variable", "barBaz"), ("string", "s"), ("comment", "-- c")}, set()),
    "Latex": ("\\section{Titel} text % c", {("string", "Titel"), ("comment", "% c")}, {"section"}),
    "Lua": ('local valA = "s" -- c\nfunction mod.runIt(arg) end', {("identifier.variable", "valA"), ("string", "s"), ("comment", "-- c"), ("identifier.function", "runIt"), ("identifier.parameter", "arg")}, set()),
    "Bash": ("valA='s' # c\nrunIt() { :; }\ncat <<EOF\nhere doc\nEOF\n", {("identifier.variable", "valA"), ("string", "s"), ("comment", "# c"), ("identifier.function", "runIt"), ("string.heredoc", "here doc")}, set()),
    "OCaml": ('let runIt x = "s" (* c *)\ntype foo = int', {("identifier.function", "runIt"), ("string", "s"), ("comment", "(* c *)"), ("identifier.type", "foo")}, set()),
    "Odin": ('runIt :: proc(arg: int) { locV := "s" } // c', {("identifier.function", "runIt"), ("identifier.parameter", "arg"), ("identifier.variable", "locV"), ("string", "s"), ("comment.line", "// c")}, set()),
    "Php": ("<?php function runIt($arg) { $loc = 's'; } // c", {("identifier.function", "runIt"), ("identifier.variable", "loc"), ("string", "s"), ("comment", "// c")}, set()),
    "Python": ('def runIt(argA, argB: "Later" = 1) -> "Other":\n    """doc"""\n    loc: "Ann" = "s"  # c\nclass Foo: pass\nimport x as modAl\nuse(other)', {("identifier.function", "runIt"), ("identifier.parameter", "argA"), ("identifier.parameter", "argB"), ("string", "doc"), ("identifier.variable", "loc"), ("string", "s"), ("comment", "# c"), ("identifier.type", "Foo"), ("identifier.module", "modAl")}, {"Later", "Other", "Ann", "other"}),
    "R": ("val <- function(arg) 's' # c", {("identifier.variable", "val"), ("identifier.parameter", "arg"), ("string", "s"), ("comment", "# c")}, set()),
    "Ruby": ('def runIt(arg)\n  loc = "s" # c\nend\nx = <<~EOS\n  body txt\nEOS\n', {("identifier.function", "runIt"), ("identifier.parameter", "arg"), ("identifier.variable", "loc"), ("string", "s"), ("comment", "# c")}, set()),
    "Swift": ('func runIt(arg: Int) { let loc = "s" } // c', {("identifier.function", "runIt"), ("identifier.parameter", "arg"), ("identifier.field", "loc"), ("string", "s"), ("comment.line", "// c")}, set()),
    "TOML": ('key = "s" # c', {("string", "s"), ("comment", "# c")}, {"key"}),
    "Typst": ('#let runIt(arg) = "s" // c', {("identifier.function", "runIt"), ("identifier.parameter", "arg"), ("string", "s"), ("comment", "// c")}, set()),
    "VHDL": ('entity Foo is -- c\nsignal bar : bit;\n"s"', {("identifier.type", "Foo"), ("comment.line", "-- c"), ("identifier.variable", "bar"), ("string", "s")}, set()),
    "YAML": ('keyA: plain words # c\nkeyB: "s"', {("identifier.field", "keyA"), ("string", "plain words"), ("comment", "# c"), ("string", "s")}, set()),
    "Zig": ('fn runIt(arg: u8) void { const loc = "s"; } // c', {("identifier.function", "runIt"), ("identifier.parameter", "arg"), ("identifier.variable", "loc"), ("string", "s"), ("comment", "// c")}, set()),
}


def found(text, language):
    raw = text.encode()
    return {(t, raw[a:b].decode()) for t, _, a, b in capture.regions(text, language)}


@pytest.mark.parametrize("language", SAMPLES)
def test_language(language):
    text, want, absent = SAMPLES[language]
    got = found(text, language)
    assert want <= got, want - got
    assert not {x for _, x in got} & absent
    assert {t for t, _ in got} <= set(TAGS)


def test_every_language_takes_anything():
    for language in (*capture.LEXERS, "Text", "Nope"):
        for text in ("", "\n", "\"'`/*#<!--", "日本 {([", "```\n", "x" * 5000):
            for tag, _, a, b in capture.regions(text, language):
                assert 0 <= a <= b <= len(text.encode())


def test_html_and_injections():
    text = 'é<p title="tipp">badword</p><script>const xVar = "in js"; // jc</script><style>.clsN { color: redd; }</style><!-- hc -->'
    got = {(t, x, text.encode()[a:b].decode()) for t, x, a, b in capture.regions(text, "HTML")}
    assert {("string", "HTML", "badword"), ("string", "HTML", "tipp"), ("identifier.variable", "Typescript", "xVar"), ("string", "Typescript", "in js"), ("comment", "Typescript", "// jc"), ("identifier.type", "Css", "clsN"), ("comment", "HTML", "<!-- hc -->")} <= got
    assert found("plain", "Text") == {("", "plain")}


def test_markdown():
    text = "# Headng\n\npara txt\n\n```python\nnam = 'str' # pc\n```\n\n```nolang\nskipped\n```\n\n```\nuntagged\n```\n\n<div>\ninner html\n</div>\n\n```html\n<script>let deep = 1</script>\n```\n"
    got = found(text, "Markdown")
    assert {("string", "Headng"), ("string", "para txt"), ("identifier.variable", "nam"), ("string", "str"), ("comment", "# pc"), ("identifier.variable", "deep")} <= got
    assert not any("skipped" in x or "untagged" in x for _, x in got) and any("inner html" in x for _, x in got)


def test_just():
    text = "set shell := ['bashy']\nmod toolz\nname := 'vall'\n# cmt\nbuild tgt:\n    echo 'hi thar' # shc\n\npy:\n    #!/usr/bin/env python\n    valp = 'pystr'\n\nodd:\n    #!/bin/unknwn\n    skippd\n"
    got = found(text, "Just")
    assert {("identifier.module", "toolz"), ("identifier.variable", "name"), ("string", "vall"), ("comment", "# cmt"), ("identifier.function", "build"), ("identifier.parameter", "tgt"), ("string", "hi thar"), ("comment", "# shc"), ("identifier.variable", "valp"), ("string", "pystr")} <= got
    assert not any("bashy" in x or "skippd" in x or "env" in x for _, x in got)


def test_columns(spark):
    docs = spark.createDataFrame([(1, SAMPLES["Rust"][0], "Rust"), (2, "all txt", "Text"), (3, None, "C"), (4, '<script>let a = "b"</script>', "HTML")], "doc_id long, text string, language string")
    areas = docs.withColumn("area", capture.region_array(F.col("text"), F.col("language")))
    kept = {r.doc_id: {x.tag for x in r.k} for r in areas.select("doc_id", capture.kept(F.col("area"), ["comment", "string"], ["comment.line"]).alias("k")).collect()}
    assert kept == {1: {"comment.block", "string"}, 2: {""}, 3: set(), 4: {"string"}}
    assert {r.doc_id: r.l for r in areas.select("doc_id", capture.languages_of(F.col("area"), F.col("language")).alias("l")).collect()}[4] == ["HTML", "Typescript"]
    assert capture.region_rows(docs, ["doc_id"]).where("doc_id = 2").first().end_byte == 7
