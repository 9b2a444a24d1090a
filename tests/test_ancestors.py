"""Captures with forbidden ancestors, by language, and nested intervals against a stack."""

import random

import pytest

from quillspark.operators import ancestors

CASES = {
    "Rust": ('#[doc = "skp"]\nimpl fmt::Display for Speling { fn fmtt() { inner(|| { "strng" }); } }\nimpl Speling { fn ownn() {} }\nfn topp() { "é" } // fn comm', ["strng", "ownn", "topp", "é"]),
    "Go": ('import (\n  "os"\n  x "fmt"\n)\nfunc mainn() { p("txt") }', ["mainn", "txt"]),
    "Java": ('@Named("skp") class Clss { @A(b = {"skp2"}) String s = "kpt"; }', ["Clss", "kpt"]),
    "Javascript": ('const a = require("skp"); function fnn(x) { return f("kpt", `tpl`); }', ["fnn", "kpt", "tpl"]),
    "Typescript": ("const m = await import('skp'); function gnn() { return 'kpt' }", ["gnn", "kpt"]),
    "Swift": ('@available("skp") func swf() { "kpt" }', ["swf", "kpt"]),
    "Dart": ("@Deprecated('skp') class Drt { var s = 'kpt'; }", ["Drt", "kpt"]),
    "Zig": ('const s = @import("skp"); fn zgg() void { p("kpt"); }', ["zgg", "kpt"]),
    "C": ('struct strct { int a; }; void f() { asm volatile ("skp"); p("kpt"); }', ["strct", "kpt"]),
    "Css": ('a { background: url("skp"); content: "kpt"; }', ["kpt"]),
    "Lua": ('local m = require("skp") function luf() return "kpt" end -- "cmt"', ["luf", "kpt"]),
    "R": ('library("skp")\nf <- function(x) g("kpt") # "cmt"', ["kpt"]),
    "Python": ('def fnn(a: Dict[str, "Skp"] = "dflt", b="kpt", *, c: "Skp2") -> "Ret":\n    return {"key": "vl"}["key2"] # "cmt"\nclass Cls: pass', ["fnn", "dflt", "kpt", "key", "vl", "key2", "Cls"]),
}


@pytest.mark.parametrize("language", CASES)
def test_languages(spark, language):
    text, want = CASES[language]
    assert [x for _, x in ancestors.one(spark, text, language)] == want


def test_intervals_equal_a_stack(spark):
    """Random blocks, some of them named: each closes where a stack closes it."""
    rng = random.Random(7)
    rows = []
    for k in range(60):
        parts = [rng.choice(["{", "}", "(", ")", " x ", ";", "impl A for B {", "é", '"{"', "// }\n"]) for _ in range(rng.randrange(40))]
        rows.append((k, "".join(parts), "Rust"))
    got = {}
    for r in ancestors.intervals(ancestors.token_rows(spark.createDataFrame(rows, "id long, text string, language string"), "id")).collect():
        got.setdefault(r.doc, set()).add((r.start, r.end))
    import regex

    for k, text, _ in rows:
        # Levels may go below 0; a block ends at the first closing delimiter of its level.
        at, level, closed, opened = 0, 0, [], []
        for m in regex.finditer(ancestors.token_pattern("slashes"), text):
            end = at + len(m[0].encode())
            if m[0] in "{([":
                level += 1
                opened.append((level, at, m.start()))
            elif m[0] in "})]":
                closed.append((level, at, end))
                level -= 1
            at = end
        want = set()
        for depth, start, place in opened:
            head = regex.search(r"[^;{}]*$", text[:place])[0]
            if text[place] == "{" and regex.search(r"\bimpl\b[^=]*\bfor\b", head):
                want.add((start, min((e for d, s, e in closed if d == depth and s > start), default=at)))
        assert got.get(k, set()) == want, text


def test_nothing_to_capture(spark):
    df = spark.createDataFrame([(1, None, "Rust"), (2, "", "Go"), (3, 'fn x() { "y" }', "Text"), (4, "fn a", None), (None, "fn nul() {}", "Rust")], "id long, text string, language string")
    assert [(r.id, r.start_byte, r.end_byte) for r in ancestors.kept_captures(df, "id").collect()] == [(None, 3, 6)]
