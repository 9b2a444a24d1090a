"""Scalar expressions over words and texts: folding, splitting, classes, coordinates.

All are Catalyst expressions, so they stay in generated code and fold when their inputs are constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with their marks, and apostrophes inside a word. Java and RE2 read it alike.
WORD_PATTERN = r"[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)*"
#: Where an identifier divides: before a capital after a small letter, before the last capital of a
#: run that a small letter follows, at both ends of a run of digits, and at separators.
IDENTIFIER_CUT = (
    r"(?<=[^\p{IsUppercase}0-9_.:])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}[a-z])|(?<=[^0-9_.:])(?=[0-9])|(?<=[0-9])(?=[^0-9_.:])|[_.:]+"
)
SCRIPTS_WITHOUT_SPACES = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"


def fold_key(word: Column) -> Column:
    """Equal for words that differ in case only: full folding for Latin, Greek and Cyrillic."""
    return F.replace(F.translate(F.lower(word), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """All words of a text in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_PATTERN})"), 1)


def split_identifier(token: Column) -> Column:
    """Parts of a camel-case, acronym, snake or dotted identifier."""
    return F.filter(F.split(token, IDENTIFIER_CUT), lambda x: x != "")


def has_letter(token: Column) -> Column:
    return token.rlike(r"\p{IsAlphabetic}")


def in_spaceless_script(token: Column) -> Column:
    """Han, Kana, Hangul and Thai are written without spaces between words; such tokens are not checked."""
    return token.rlike(SCRIPTS_WITHOUT_SPACES)


def has_number(word: Column) -> Column:
    return word.rlike(r"\p{N}")


def checkable(word: Column, min_length: int = 3) -> Column:
    """Has letters, no numeric sign, at least min_length characters and a script with spaces."""
    return has_letter(word) & ~has_number(word) & ~in_spaceless_script(word) & (F.char_length(word) >= min_length)


def word_case(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsUppercase}+$"), "all_caps").when(word.rlike(r"^\p{IsLowercase}+$"), "all_lower").when(word.rlike(r"^\p{IsUppercase}"), "title").otherwise("unknown")


def recased(suggestion: Column, like: Column) -> Column:
    """A suggestion in the case of the word it is for; ASCII letters only, titles as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    case = word_case(like)
    return F.when(case == "all_caps", F.translate(suggestion, lower, upper)).when(case == "all_lower", F.translate(suggestion, upper, lower)).otherwise(suggestion)


def before(text: Column, byte: Column) -> Column:
    """The text up to a byte offset."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte.cast("int")), "UTF-8")


def at_bytes(text: Column, start: Column, end: Column) -> Column:
    """The slice between two byte offsets."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def line_col(text: Column, byte: Column) -> Column:
    """(line, col), both from 1, columns in characters."""
    head = before(text, F.least(byte, F.octet_length(text)))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.cast("long").alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).cast("long").alias("col"))


def utf16_line_col(text: Column, byte: Column) -> Column:
    """(line, col), both from 0, columns in UTF-16 units."""
    head = before(text, F.least(byte, F.octet_length(text)))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct(line.cast("long").alias("line"), (F.octet_length(F.encode(F.substring_index(head, "\n", -1), "UTF-16BE")) / 2).cast("long").alias("col"))


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The slice between two UTF-16 offsets; offsets beyond the text saturate."""
    units = F.encode(text, "UTF-16BE")
    last = (F.octet_length(units) / 2).cast("int")
    low, high = F.least(start, last), F.least(end, last)
    return F.decode(F.substring(units, (low * 2 + 1).cast("int"), (F.greatest(high - low, F.lit(0)) * 2).cast("int")), "UTF-16BE")


def nth_line(text: Column, line: Column) -> Column:
    """Line number `line`, from 0; null beyond the last."""
    return F.get(F.split(text, "\n"), line.cast("int"))


def tag_matches(tag: Column, pattern: str) -> Column:
    """Equal, or below the pattern in the dotted hierarchy."""
    return (tag == pattern) | tag.startswith(f"{pattern}.")


def tag_checked(tag: Column, include: list[str], exclude: list[str]) -> Column:
    """Excluded tags lose; if any are included, only those pass."""
    out = F.lit(not include)
    for p in include:
        out = out | tag_matches(tag, p)
    for p in exclude:
        out = out & ~tag_matches(tag, p)
    return out


def back_off(attempts: Column) -> Column:
    """Seconds to wait after a number of failed attempts."""
    return F.least(F.lit(30) * F.pow(F.lit(2), F.least(attempts, F.lit(7))), F.lit(3600)).cast("long")


def env_flag(value: Column) -> Column:
    """Unset, empty, 0 and false (in any case) are false."""
    return F.coalesce(~F.lower(value).isin("", "0", "false"), F.lit(False))


def http_date(value: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))


def severity(name: Column) -> Column:
    """Severity numbers of the editor protocol; unknown names are information."""
    lower = F.lower(name)
    return F.when(lower == "error", 1).when(lower == "warning", 2).when(lower == "hint", 4).otherwise(3)


def cache_name(url: Column) -> Column:
    return F.sha2(url, 256)
