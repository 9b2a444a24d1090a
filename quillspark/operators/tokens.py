"""Tokens with byte offsets: segmentation, white space, identifiers.

`token_rows` is Arrow-batched Python with Unicode's word boundaries; `word_rows` is the same job in
Catalyst expressions without offsets, for counts over a corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import CANDIDATE
from .ranges import byte_offsets, listed, sliced

_tools: dict[str, object] = {}


def _regex(name: str, pattern: str, flags: str = ""):
    import regex

    if name not in _tools:
        _tools[name] = regex.compile(flags + pattern)
    return _tools[name]


def segments(text: str) -> Iterator[tuple[int, str]]:
    """(first character, token) between Unicode word boundaries, cut again at white space."""
    plain = _regex("plain", r"[^\p{White_Space}]+")
    a = 0
    for m in _regex("bounds", r"\b", "(?V1w)").finditer(text):
        b = m.start()
        token = text[a:b]
        if token.isalnum():
            yield a, token
        elif not token.isspace():
            for x in plain.finditer(token):
                yield a + x.start(), x[0]
        a = b
    for x in plain.finditer(text, a):
        yield x.start(), x[0]


def parts(token: str) -> Iterator[tuple[int, str]]:
    """(first character, part) of an identifier."""
    cut = _regex("cut", X.IDENTIFIER_CUT.replace("IsUppercase", "Uppercase"), "(?V1)")
    at = 0
    for m in cut.finditer(token):
        if m.start() > at:
            yield at, token[at : m.start()]
        at = m.end()
    if at < len(token):
        yield at, token[at:]


def is_plain(token: str) -> bool:
    """Letters in small or title case: nothing to split, and no numeric sign."""
    return token.isalpha() and (token.islower() or (token[0].isupper() and token[1:].islower()))


def within(a: int, b: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a >= s and b <= e for s, e in ranges)


def candidates(text: str, skip: list[tuple[int, int]], regions: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Words to check with their bytes, in regions (byte ranges) of the text, or all of it.

    A token goes if it has no letter, a script without spaces, or lies in a skipped range; then its
    parts go that have a numeric sign or lie in one.
    """
    letter, spaceless, number = _regex("letter", r"\p{Alphabetic}"), _regex("spaceless", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]"), _regex("number", r"\p{N}")
    raw = text.encode()
    strange = not text.isascii() and spaceless.search(text) is not None
    out = []
    for first, last in regions if regions is not None else [(0, len(raw))]:
        piece = text if (first, last) == (0, len(raw)) else raw[first:last].decode("utf-8", "ignore")
        at = byte_offsets(piece)
        for start, token in segments(piece):
            if not (token.isalpha() or letter.search(token)) or (strange and spaceless.search(token)):
                continue
            a, b = first + at[start], first + at[start + len(token)]
            if skip and within(a, b, skip):
                continue
            if is_plain(token):
                out.append((token, a, b))
                continue
            for k, part in parts(token):
                a, b = first + at[start + k], first + at[start + k + len(part)]
                if not number.search(part) and not (skip and within(a, b, skip)):
                    out.append((part, a, b))
    return out


def token_rows(docs: DataFrame, text: str, skip: Column, keep: list[str], regions: Column | None = None) -> DataFrame:
    """docs -> keep columns, word, start_byte, end_byte. `skip`, `regions`: arrays of ranges; what lies in several regions of a text is there once."""

    @F.arrow_udf(T.ArrayType(CANDIDATE))
    @sliced
    def run(texts: pa.Array, skips: pa.Array, areas: pa.Array) -> pa.Array:
        pairs = lambda rs: [(r["start_byte"], r["end_byte"]) for r in rs]
        rows = [list(dict.fromkeys(candidates(t or "", pairs(s), None if r is None else pairs(r)))) for t, s, r in zip(texts.to_pylist(), skips.to_pylist(), areas.to_pylist(), strict=True)]
        return listed(rows, CANDIDATE)

    areas = F.lit(None).cast("array<struct<start_byte:bigint,end_byte:bigint>>") if regions is None else regions
    return docs.select(*keep, F.inline(run(F.col(text), skip, areas)))


def word_rows(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """docs -> keep columns and word, a row for each word of the text, in generated code."""
    return docs.select(*keep, F.explode(X.words(F.col(text))).alias("word"))


def identifier_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep columns, pos and part of the identifiers in a column; parts with a numeric sign go."""
    return df.select(*keep, F.posexplode(X.split_identifier(F.col(column))).alias("pos", "part")).where(~X.has_number(F.col("part")))
