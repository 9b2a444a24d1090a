"""Regions of source code and markup that are worth checking.

Each language has a lexer of its own here: comments and strings by their delimiters, and the
places where names are defined (uses are not captured) by patterns over the code between them. This is an
approximation of a grammar: nesting that delimiters do not show is not seen. Where a
rule needs an ancestor (a string in a Python annotation, a function of a Rust trait implementation,
a back-tick in a recipe body), the lexer tracks that construct itself.

Regions are (tag, language, start_byte, end_byte) in the outer text. Markup and recipes inject other
languages; what names no known language is skipped, and plain text is one region.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.registry import language_of_id
from ..schema import REGION
from .ranges import byte_offsets, listed, sliced

I = r"[A-Za-z_][A-Za-z0-9_]*"  # noqa: E741
C_STRINGS = (r'"(?P<s>(?:\\.|[^"\\\n])*)"',)
QUOTES = (*C_STRINGS, r"'(?P<s>(?:\\.|[^'\\\n])*)'")


@dataclass(frozen=True)
class Lexer:
    """Patterns of comments (by tag) and strings, in the order they are tried, and of definitions.

    A definition is (tag, pattern); its group `n` is the name, or several of them.
    """

    comments: tuple[tuple[str, str], ...] = ()
    strings: tuple[str, ...] = QUOTES
    definitions: tuple[tuple[str, str], ...] = ()
    special: tuple[str, ...] = ()
    exclude: str = ""


def _c_comments(line: str = "comment", block: str = "comment") -> tuple:
    return ((line, r"//[^\n]*"), (block, r"/\*[\s\S]*?(?:\*/|\Z)"))


HASH = (("comment", r"\#[^\n]*"),)
_param = lambda before: ("identifier.parameter", before)

#: Function, type and variable definitions by family; `n` is what is named.
_JS = (
    ("identifier.function", rf"\bfunction\b\s*\*?\s*(?P<n>{I})"),
    ("identifier.type", rf"\b(?:class|interface|enum)\s+(?P<n>{I})"),
    ("identifier.variable", rf"\b(?:const|let|var)\s+(?P<n>{I})"),
    ("identifier.parameter", rf"\bfunction\b[^(\n]*\((?P<n>[^()]*)\)"),
    ("identifier.parameter", r"\((?P<n>[^()]*)\)\s*(?::[^=\n{]+)?=>"),
    ("identifier.field", rf"(?m)^\s*(?P<n>{I})\s*[?]?:"),
    ("identifier.function", rf"(?m)^\s*(?:async\s+|static\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(?P<n>{I})\s*\([^()\n]*\)\s*(?::[^{{\n]+)?\{{"),
)
_C = (
    ("identifier.function", rf"(?m)^[A-Za-z_][\w\s*&:<>,~]*?[\s*&](?!if\b|for\b|while\b|switch\b|return\b|else\b)(?P<n>{I})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:override\s*)?\{{"),
    ("identifier.type", rf"\b(?:struct|enum|union|class|namespace)\s+(?P<n>{I})\s*[{{:]"),
    ("identifier.type", rf"\btypedef\b[^;]*?\b(?P<n>{I})\s*;"),
    ("identifier.constant", rf"(?m)^\s*\#\s*define\s+(?P<n>{I})"),
    ("identifier.variable", rf"\b(?:int|char|float|double|bool|auto|long|short|unsigned|size_t|string)\b[\s*&]+(?P<n>{I})\s*(?:=|;|\[)"),
    ("identifier.parameter", rf"[(,]\s*(?:const\s+)?[A-Za-z_][\w:<>]*[\s*&]+(?P<n>{I})\s*(?=[,)])"),
)
_JVM = (
    ("identifier.type", rf"\b(?:class|interface|enum|record|struct|mixin|extension|delegate)\s+(?P<n>{I})"),
    ("identifier.function", rf"(?!\b(?:if|for|while|switch|catch|return|new|else)\b)\b[A-Za-z_][\w<>\[\],?.]*\s+(?P<n>{I})\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w,\s]+)?(?:async\s*)?(?:\{{|=>)"),
    ("identifier.variable", rf"\b(?:var|val|final|late|int|long|double|float|boolean|bool|char|String|string|num)\s+(?:[A-Z]\w*\s+)?(?P<n>{I})\s*(?==|;)"),
    ("identifier.constant", r"\b(?:const|static\s+final)\s+(?:[\w<>\[\]]+\s+)?(?P<n>[A-Za-z_]\w*)\s*="),
    ("identifier.parameter", rf"[(,]\s*(?:final\s+|required\s+|ref\s+|out\s+)*[A-Za-z_][\w<>\[\].?]*\s+(?P<n>{I})\s*(?=[,)])"),
    ("identifier.module", rf"\b(?:namespace|import\s+\w+\s+as|library)\s+(?P<n>{I})"),
)

LEXERS: dict[str, Lexer] = {
    "Rust": Lexer(_c_comments("comment.line", "comment.block"), (r'r(?P<h>\#*)"(?P<s>[\s\S]*?)"(?P=h)', r'"(?P<s>(?:\\[\s\S]|[^"\\])*)"', r"'(?:\\.|[^'\\\n])'"), (
        ("identifier.function", rf"\bfn\s+(?P<n>{I})"), ("identifier.type", rf"\bstruct\s+(?P<n>{I})"), ("identifier.variable", rf"\blet\s+(?:mut\s+)?(?P<n>{I})"),
        ("identifier.field", rf"(?m)(?:^|[{{,])\s*(?:pub(?:\([^)]*\))?\s+)?(?P<n>{I})\s*:(?!:)"), ("identifier.parameter", rf"\bfn\s+{I}(?:<[^>]*>)?\s*\((?P<n>[^)]*)\)"),
    ), exclude=r"\bimpl\b[^{};]*\bfor\b[^{};]*\{"),
    "C": Lexer(_c_comments(), C_STRINGS, _C),
    "Cpp": Lexer(_c_comments(), (r'R"(?P<h>[^(]*)\((?P<s>[\s\S]*?)\)(?P=h)"', *C_STRINGS), _C),
    "CSharp": Lexer(_c_comments(), (r'@"(?P<s>(?:""|[^"])*)"', *C_STRINGS), (*_JVM, ("identifier.field", rf"\b(?:public|private|protected|internal)\s+(?:static\s+|readonly\s+)*[\w<>\[\]?]+\s+(?P<n>{I})\s*[;={{]"))),
    "Java": Lexer(_c_comments(), (r'"""(?P<s>[\s\S]*?)"""', *C_STRINGS), _JVM),
    "Dart": Lexer(_c_comments(), (r"'''(?P<s>[\s\S]*?)'''", r'"""(?P<s>[\s\S]*?)"""', *QUOTES), _JVM),
    "Javascript": Lexer(_c_comments(), (r"`(?P<s>(?:\\[\s\S]|[^`\\])*)`", *QUOTES), _JS),
    "Typescript": Lexer(_c_comments(), (r"`(?P<s>(?:\\[\s\S]|[^`\\])*)`", *QUOTES), _JS),
    "Tsx": Lexer(_c_comments(), (r"`(?P<s>(?:\\[\s\S]|[^`\\])*)`", *QUOTES), _JS),
    "Css": Lexer((("comment", r"/\*[\s\S]*?(?:\*/|\Z)"),), QUOTES, (
        ("identifier.type", r"[.\#](?P<n>[A-Za-z_-][\w-]*)(?=[^{};]*\{)"), ("identifier.field", r"(?P<n>[A-Za-z-]+)\s*:(?=[^{}]*[;}])"), ("identifier", r":\s*(?P<n>[A-Za-z-]+)\s*[;}]"),
    )),
    "Elixir": Lexer(HASH, (r'"""(?P<s>[\s\S]*?)"""', *QUOTES), (
        ("identifier.type", rf"\bdefmodule\s+(?P<n>[\w.]+)"), ("identifier.function", rf"\bdefp?\s+(?P<n>{I})"), ("identifier.variable", rf"(?P<n>{I})\s*(?:=(?![=~>])|<-)"),
    ), (r"~[a-zA-Z](?P<s>\([^)]*\)|\[[^\]]*\]|/[^/\n]*/|\"[^\"\n]*\")",)),
    "Erlang": Lexer((("comment", r"%[^\n]*"),), C_STRINGS, (("identifier.function", r"(?m)^(?P<n>[a-z]\w*)\s*\("), ("identifier.variable", r"\b(?P<n>[A-Z]\w*)"))),
    "Go": Lexer(_c_comments(), (r"`(?P<s>[^`]*)`", *C_STRINGS), (
        ("identifier.function", rf"\bfunc\s+(?:\([^)]*\)\s*)?(?P<n>{I})"), ("identifier.type", rf"\btype\s+(?P<n>{I})"), ("identifier.module", rf"\bpackage\s+(?P<n>{I})"),
        ("identifier.variable", rf"\bvar\s+(?P<n>{I})"), ("identifier.variable", rf"(?P<n>{I}(?:\s*,\s*{I})*)\s*:="), ("identifier.constant", rf"\bconst\s+(?P<n>{I})"),
        ("identifier.parameter", rf"\bfunc\b[^(\n]*\((?P<n>[^)]*)\)"), ("identifier.field", rf"(?m)^\s+(?P<n>[A-Z]\w*)\s+[\w\[\]*.]+\s*(?:$|`)"),
    )),
    "HTML": Lexer(),
    "Haskell": Lexer((("comment", r"--[^\n]*"), ("comment", r"\{-[\s\S]*?(?:-\}|\Z)")), C_STRINGS, (("identifier.module", r"\bmodule\s+(?P<n>[\w.]+)"), ("identifier.variable", r"(?m)^(?P<n>[a-z]\w*)(?=\s.*=|\s*::)"))),
    "Just": Lexer(HASH, QUOTES),
    "Latex": Lexer((("comment", r"(?<!\\)%[^\n]*"),), ()),
    "Lua": Lexer((("comment", r"--\[\[[\s\S]*?(?:\]\]|\Z)"), ("comment", r"--[^\n]*")), (r"\[\[(?P<s>[\s\S]*?)\]\]", *QUOTES), (
        ("identifier.function", rf"\bfunction\s+(?:{I}[.:])*(?P<n>{I})"), ("identifier.variable", rf"\blocal\s+(?!function\b)(?P<n>{I}(?:\s*,\s*{I})*)"),
        ("identifier.parameter", r"\bfunction\b[^(\n]*\((?P<n>[^)]*)\)"), ("identifier.field", rf"[{{,]\s*(?P<n>{I})\s*="),
    )),
    "Markdown": Lexer(),
    "Bash": Lexer((("comment", r"(?<![\w$\\{])\#[^\n]*"),), (r"<<-?\s*['\"]?(?P<h>\w+)['\"]?[^\n]*\n(?P<heredoc>[\s\S]*?)\n\s*(?P=h)\b", r'"(?P<s>(?:\\[\s\S]|[^"\\])*)"', r"'(?P<s>[^']*)'"), (
        ("identifier.function", rf"(?m)^\s*(?:function\s+)?(?P<n>{I})\s*\(\)"), ("identifier.function", rf"\bfunction\s+(?P<n>{I})"), ("identifier.variable", rf"(?m)(?:^|[;&|]|\b(?:export|local|readonly|declare)\s)\s*(?P<n>{I})="),
    )),
    "OCaml": Lexer((("comment", r"\(\*[\s\S]*?(?:\*\)|\Z)"),), (r"\{(?P<h>\w*)\|(?P<heredoc>[\s\S]*?)\|(?P=h)\}", *C_STRINGS), (
        ("identifier.function", rf"\blet\s+(?:rec\s+)?(?P<n>{I})\s+[\w(~]"), ("identifier.constant", rf"\blet\s+(?P<n>{I})\s*="), ("identifier.type", rf"\btype\s+(?P<n>{I})"), ("identifier.module", rf"\bmodule\s+(?P<n>{I})"),
    )),
    "Odin": Lexer(_c_comments("comment.line", "comment.block"), (r"`(?P<s>[^`]*)`", *C_STRINGS), (
        ("identifier.function", rf"(?P<n>{I})\s*::\s*proc\b"), ("identifier.type", rf"(?P<n>{I})\s*::\s*(?:struct|enum|union)\b"), ("identifier.constant", rf"(?P<n>{I})\s*::(?!\s*(?:proc|struct|enum|union)\b)"),
        ("identifier.variable", rf"(?P<n>{I})\s*:="), ("identifier.parameter", r"\bproc\s*\((?P<n>[^)]*)\)"), ("identifier.field", rf"(?m)^\s+(?P<n>{I})\s*:(?![=:])"),
    )),
    "Php": Lexer((*_c_comments(), *HASH), QUOTES, (
        ("identifier.function", rf"\bfunction\s+&?(?P<n>{I})"), ("identifier.type", rf"\b(?:class|interface|trait|enum)\s+(?P<n>{I})"), ("identifier.module", r"\bnamespace\s+(?P<n>[\w\\]+)"),
        ("identifier.constant", rf"\bconst\s+(?P<n>{I})"), ("identifier.variable", rf"\$(?P<n>{I})\s*=(?!=)"), ("identifier.parameter", r"\bfunction\b[^(\n]*\((?P<n>[^)]*)\)"),
    )),
    "Python": Lexer(HASH, (r'[rbfuRBFU]{0,2}"""(?P<s>[\s\S]*?)"""', r"[rbfuRBFU]{0,2}'''(?P<s>[\s\S]*?)'''", *(f"[rbfuRBFU]{{0,2}}{q}" for q in QUOTES)), (
        ("identifier.function", rf"\bdef\s+(?P<n>{I})"), ("identifier.type", rf"\bclass\s+(?P<n>{I})"), ("identifier.variable", rf"(?m)^[ \t]*(?P<n>{I})\s*(?::[^=\n]+)?=(?!=)"),
        ("identifier.parameter", r"\bdef\s+\w+\s*(?:\[[^\]]*\])?\((?P<n>[^()]*(?:\([^()]*\)[^()]*)*)\)"), ("identifier.module", rf"\bimport\b[^\n]*?\bas\s+(?P<n>{I})"),
    )),
    "R": Lexer(HASH, QUOTES, (("identifier.variable", r"(?P<n>[A-Za-z.][\w.]*)\s*(?:<-|=(?!=))"), ("identifier.parameter", r"\bfunction\s*\((?P<n>[^)]*)\)"), ("identifier.field", r"\$(?P<n>[A-Za-z.][\w.]*)"))),
    "Ruby": Lexer((*HASH, ("comment", r"(?m)^=begin[\s\S]*?^=end")), (r"<<[~-]?['\"]?(?P<h>[A-Z_]+)['\"]?[^\n]*\n(?P<heredoc>[\s\S]*?)\n\s*(?P=h)\b", *QUOTES), (
        ("identifier.function", rf"\bdef\s+(?:self\.)?(?P<n>{I})"), ("identifier.variable", rf"(?m)^\s*(?P<n>{I})\s*=(?![=~>])"), ("identifier.parameter", r"\bdef\s+[\w.]+[?!]?\s*\((?P<n>[^)]*)\)"),
    )),
    "Swift": Lexer(_c_comments("comment.line", "comment.block"), (r'"""(?P<s>[\s\S]*?)"""', *C_STRINGS), (
        ("identifier.function", rf"\bfunc\s+(?P<n>{I})"), ("identifier.type", rf"\b(?:class|struct|enum|protocol)\s+(?P<n>{I})"), ("identifier.field", rf"\b(?:let|var)\s+(?P<n>{I})"), ("identifier.parameter", r"\bfunc\s+\w+(?:<[^>]*>)?\s*\((?P<n>[^)]*)\)"),
    )),
    "TOML": Lexer(HASH, (r'"""(?P<s>[\s\S]*?)"""', r"'''(?P<s>[\s\S]*?)'''", *QUOTES)),
    "Typst": Lexer(_c_comments(), C_STRINGS, (
        ("identifier.function", rf"\blet\s+(?P<n>{I})\s*\("), ("identifier.variable", rf"\blet\s+(?P<n>{I})\s*="), ("identifier.parameter", rf"\blet\s+{I}\((?P<n>[^)]*)\)"),
    )),
    "VHDL": Lexer((("comment.line", r"--[^\n]*"), ("comment.block", r"/\*[\s\S]*?(?:\*/|\Z)")), C_STRINGS, (
        ("identifier.type", rf"(?i)\b(?:entity|architecture|type|subtype|component)\s+(?P<n>{I})"), ("identifier.function", rf"(?i)\b(?:function|procedure)\s+(?P<n>{I})"),
        ("identifier.variable", rf"(?i)\b(?:signal|variable)\s+(?P<n>{I})"), ("identifier.constant", rf"(?i)\bconstant\s+(?P<n>{I})"), ("identifier.module", rf"(?i)\bpackage\s+(?P<n>{I})"),
        ("identifier.parameter", rf"(?i)[(;]\s*(?:signal\s+)?(?P<n>{I})\s*:\s*(?:in|out|inout)\b"),
    )),
    "YAML": Lexer((("comment", r"(?:(?<=\s)|(?m:^))\#[^\n]*"),), QUOTES, (("identifier.field", r"(?m)^\s*(?:-\s+)?(?P<n>[A-Za-z_][\w -]*?)\s*:(?=\s|$)"), ("string", r"(?m)(?::|-)[ \t]+(?P<n>[^\s\"'|>&*{\[\#:-][^\n:\#]*?)[ \t]*$"))),
    "Zig": Lexer((("comment", r"//[^\n]*"),), C_STRINGS, (
        ("identifier.function", rf"\bfn\s+(?P<n>{I})"), ("identifier.variable", rf"\b(?:const|var)\s+(?P<n>{I})"), ("identifier.field", rf"(?m)^\s+(?P<n>{I})\s*:"), ("identifier.parameter", rf"\bfn\s+{I}\s*\((?P<n>[^)]*)\)"),
    )),
}

_built: dict[str, tuple] = {}
_NAME = r"(?<![\w$.@])(?P<x>[A-Za-z_][\w]*)\s*(?=[:,=)?]|\s+[A-Za-z_&*\[<.(]|$)"


def _tools(language: str):
    import regex

    if language not in _built:
        lex = LEXERS[language]
        spans = [(tag, regex.compile(p)) for tag, p in lex.comments] + [("string", regex.compile(p)) for p in lex.strings] + [("string.special", regex.compile(p)) for p in lex.special]
        _built[language] = (spans, [(tag, regex.compile(p)) for tag, p in lex.definitions], regex.compile(lex.exclude) if lex.exclude else None, regex.compile(_NAME), regex.compile(r"[A-Za-z_][\w.-]*"))
    return _built[language]


def spans(text: str, language: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(tag, first, last, first of content, last of content) of comments and strings, from the left."""
    rules = _tools(language)[0]
    at, held = 0, {}
    while True:
        best = None
        for k, (tag, pattern) in enumerate(rules):
            m = held.get(k)
            if m is None or (m and m.start() < at):
                m = held[k] = pattern.search(text, at) or False
            if m and (best is None or m.start() < best[1].start()):
                best = (tag, m)
        if best is None:
            return
        tag, m = best
        groups = m.groupdict()
        name = "heredoc" if groups.get("heredoc") is not None else "s" if groups.get("s") is not None else 0
        yield ("string.heredoc" if name == "heredoc" else tag), m.start(), m.end(), m.start(name), m.end(name)
        at = max(m.end(), at + 1)


def blocks(code: str, head) -> list[tuple[int, int]]:
    """The brace blocks that start where `head` matches."""
    out = []
    for m in head.finditer(code):
        depth, i = 1, m.end()
        while i < len(code) and depth:
            depth += {"{": 1, "}": -1}.get(code[i], 0)
            i += 1
        out.append((m.end(), i))
    return out


def lexed(text: str, language: str) -> Iterator[tuple[str, int, int]]:
    """(tag, first, last) in characters."""
    _, definitions, exclude, name, word = _tools(language)
    code = list(text)
    quoted = []
    for tag, a, b, s, e in spans(text, language):
        code[a:b] = ["\n" if c == "\n" else " " for c in text[a:b]]
        quoted.append((tag, a, b, s, e))
    bare = "".join(code)
    skipped = blocks(bare, exclude) if exclude else []
    for tag, a, b, s, e in quoted:
        if language == "Python" and tag == "string" and _annotated(bare, a, b):
            continue
        if s < e:
            yield tag, s, e
    for tag, pattern in definitions:
        for m in pattern.finditer(bare):
            a, b = m.span("n")
            if tag == "identifier.function" and any(x <= a < y for x, y in skipped):
                continue
            if tag == "identifier.parameter" or "," in m["n"]:
                for p in name.finditer(bare[a:b]) if tag == "identifier.parameter" else word.finditer(bare, a, b):
                    shift = a if tag == "identifier.parameter" else 0
                    x = p.span("x") if tag == "identifier.parameter" else p.span()
                    yield tag, shift + x[0], shift + x[1]
            elif a < b:
                yield tag, a, b


def _annotated(bare: str, a: int, b: int) -> bool:
    """Whether a Python string stands in a type: after a colon or arrow in a signature or target, or in brackets there."""
    line = bare[bare.rfind("\n", 0, a) + 1 : a]
    opened = line.rstrip()
    if opened.endswith("->"):
        return True
    head = line.lstrip()
    after = bare[b : bare.find("\n", b) if bare.find("\n", b) >= 0 else len(bare)]
    in_signature = head.startswith(("def ", "async def "))
    if in_signature and opened.endswith((":", "[", ",", "|")) and ":" in line[line.find("(") :] and "=" not in line[line.rfind(",") + 1 :]:
        return True
    return not in_signature and opened.endswith((":", "[")) and head.split(":")[0].strip().isidentifier() and "=" not in line and not after.lstrip().startswith(":") and head.split(":")[0].strip() not in ("else", "try", "finally", "lambda")


def html(text: str) -> Iterator[tuple[str, int, int, str | None]]:
    import regex

    tools = _built.setdefault("_html", (regex.compile(r"(?s)<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>(?P<body>.*?)</(?P=raw)\s*>|<[!/?a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", regex.I), regex.compile(r"=\s*(?:\"(?P<v>[^\"]*)\"|'(?P<v>[^']*)')")))
    at = 0
    for m in tools[0].finditer(text):
        if text[at : m.start()].strip():
            yield "string", at, m.start(), None
        at = m.end()
        if m[0].startswith("<!--"):
            yield "comment", m.start(), m.end(), None
            continue
        head_end = m.start("body") if m["raw"] else m.end()
        for v in tools[1].finditer(text, m.start(), head_end):
            if v["v"]:
                yield "string", *v.span("v"), None
        if m["raw"] and m["body"].strip():
            yield "injection", *m.span("body"), "Typescript" if m["raw"].lower() == "script" else "Css"
    if text[at:].strip():
        yield "string", at, len(text), None


def markdown(text: str) -> Iterator[tuple[str, int, int, str | None]]:
    """Paragraphs and headings are strings; fences with a known language and HTML blocks are injected."""
    import regex

    fence = _built.setdefault("_fence", (regex.compile(r"(?m)^ {0,3}(?P<f>`{3,}|~{3,})[ \t]*(?P<lang>[^\s`]*)[^\n]*\n(?P<body>[\s\S]*?)(?:^ {0,3}(?P=f)[`~]*[ \t]*$|\Z)"), regex.compile(r"(?m)^ {0,3}</?[a-zA-Z!][^\n]*(?:\n(?!\s*$)[^\n]*)*"), regex.compile(r"(?m)^(?: {0,3}(?:\#{1,6}|[-*+>]|\d+[.)])[ \t]+)?(?P<t>[^\n]*\S[^\n]*)$")))
    at, plain = 0, []
    for m in fence[0].finditer(text):
        plain.append((at, m.start()))
        at = m.end()
        language = language_of_id(m["lang"].strip().lower()) if m["lang"] else "Text"
        if language != "Text" and m["body"]:
            yield "injection", *m.span("body"), language
    plain.append((at, len(text)))
    for a, b in plain:
        last = a
        for m in [*fence[1].finditer(text, a, b), None]:
            stop = m.start() if m else b
            for t in fence[2].finditer(text, last, stop):
                if not text[t.start() : t.end()].startswith("    "):
                    yield "string", *t.span("t"), None
            if m:
                yield "injection", m.start(), m.end(), "HTML"
                last = m.end()


def just(text: str) -> Iterator[tuple[str, int, int, str | None]]:
    """Recipes, their parameters and variables; bodies run in a shell or what their shebang names."""
    import regex

    tools = _built.setdefault("_just", (regex.compile(r"(?m)^@?(?P<n>[A-Za-z_][\w-]*)(?P<p>(?:[ \t]+[^\n:=]+)?)[ \t]*:(?!=)[^\n]*\n(?P<body>(?:[ \t]+[^\n]*(?:\n|\Z)|[ \t]*\n(?=[ \t]))*)"), regex.compile(r"(?m)^(?:export[ \t]+)?(?P<n>[A-Za-z_][\w-]*)[ \t]*:="), regex.compile(r"(?m)^[ \t]*\#[^\n]*"), regex.compile(r"[A-Za-z_][\w-]*"), regex.compile(r"`(?P<s>[^`\n]*)`"), regex.compile(r"(?m)^(?P<n>mod)\??[ \t]+(?P<m>[A-Za-z_][\w-]*)"), regex.compile(r"(?m)^(?:set|import|mod)\b[^\n]*")))
    covered = []
    for m in tools[0].finditer(text):
        yield "identifier.function", *m.span("n"), None
        for p in tools[3].finditer(text, *m.span("p")):
            yield "identifier.parameter", *p.span(), None
        a, b = m.span("body")
        covered.append((a, b))
        body = text[a:b]
        if body.lstrip().startswith("#!"):
            line, _, _ = body.partition("\n")
            language = language_of_id(line.rsplit("/", 1)[-1].replace("env ", "").strip().split(" ")[0].lower())
            if language != "Text" and a + len(line) + 1 < b:
                yield "injection", a + len(line) + 1, b, language
        elif body.strip():
            yield "injection", a, b, "Bash"
    inside = lambda k: any(x <= k < y for x, y in covered)
    for m in tools[1].finditer(text):
        yield "identifier.variable", *m.span("n"), None
    for m in tools[5].finditer(text):
        yield "identifier.module", *m.span("m"), None
    for m in tools[2].finditer(text):
        if not inside(m.start()):
            yield "comment", m.start(), m.end(), None
    for m in tools[4].finditer(text):
        if not inside(m.start()) and m["s"]:
            yield "injection", *m.span("s"), "Bash"
    settings = [m.span() for m in tools[6].finditer(text)]
    for tag, a, _, s, e in spans(text, "Just"):
        if tag == "string" and not inside(a) and not any(x <= a < y for x, y in settings) and s < e:
            yield "string", s, e, None


def latex(text: str) -> Iterator[tuple[str, int, int, str | None]]:
    import regex

    tools = _built.setdefault("_latex", (regex.compile(r"(?<!\\)%[^\n]*"), regex.compile(r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?|\$[^$]*\$|[{}&~^_]|\\.")))
    at = 0
    for m in [*tools[0].finditer(text), None]:
        stop = m.start() if m else len(text)
        last = at
        for c in [*tools[1].finditer(text, at, stop), None]:
            end = c.start() if c else stop
            if text[last:end].strip():
                yield "string", last, end, None
            last = c.end() if c else stop
        if m:
            yield "comment", m.start(), m.end(), None
            at = m.end()


MARKUP = {"HTML": html, "Markdown": markdown, "Just": just, "Latex": latex}


def regions(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """(tag, language, first byte, last byte); Text is one region with an empty tag.

    What is injected is looked into as deep as it goes; a region that would inject all of itself again in its own
    language ends there.
    """
    out, open_ = set(), [(text, language, 0)]
    while open_:
        text, language, first = open_.pop()
        raw = byte_offsets(text)
        if language not in LEXERS:
            if text:
                out.add(("", "Text", first, first + raw[len(text)]))
            continue
        for tag, a, b, inner in MARKUP[language](text) if language in MARKUP else ((t, a, b, None) for t, a, b in lexed(text, language)):
            if inner is None:
                out.add((tag, language, first + raw[a], first + raw[b]))
            elif (inner, b - a) != (language, len(text)):
                open_.append((text[a:b], inner, first + raw[a]))
    return sorted(out, key=lambda r: (r[2], r[3], r[0]))


def outline(text: str, language: str) -> list[str]:
    """Regions as lines `tag language [first-last] text`, indented by the regions around them."""
    raw, lines, around = text.encode(), [], []
    for tag, own, a, b in sorted(regions(text, language), key=lambda r: (r[2], -r[3])):
        while around and around[-1] < b:
            around.pop()
        lines.append(f"{'  ' * len(around)}{tag or 'text'} {own} [{a}-{b}] {raw[a:b].decode(errors='replace')[:60]!r}")
        around.append(b)
    return lines


def region_array(text: Column, language: Column) -> Column:
    """An array of regions for each text; Arrow-batched."""

    @F.arrow_udf(T.ArrayType(REGION))
    @sliced
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return listed([regions(t or "", x) for t, x in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], REGION)

    return run(text, language)


def kept(area: Column, include: list[str], exclude: list[str]) -> Column:
    """The regions that tags leave; plain text has no tags and stays."""
    return F.filter(area, lambda r: (r["language"] == "Text") | X.tag_checked(r["tag"], include, exclude))


def languages_of(area: Column, own: Column) -> Column:
    """A document's language and all that were injected."""
    return F.array_sort(F.array_distinct(F.concat(F.array(own), F.transform(area, lambda r: r["language"]))))


def region_rows(docs: DataFrame, keep: list[str], text: str = "text", language: str = "language") -> DataFrame:
    return docs.select(*keep, F.inline(region_array(F.col(text), F.col(language))))
