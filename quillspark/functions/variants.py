"""German spellings without umlauts: the variants a word may stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PAIRS = 4
#: Two letters and the one they transliterate. `SS` stays.
PAIRS = {"ae": "ä", "Ae": "Ä", "AE": "Ä", "oe": "ö", "Oe": "Ö", "OE": "Ö", "ue": "ü", "Ue": "Ü", "UE": "Ü", "ss": "ß"}
_CUT = "(" + "|".join(PAIRS) + ")"


def pieces(word: Column) -> Column:
    """The word cut around its pairs, from the left: odd places are pairs."""
    return F.split(F.regexp_replace(word, _CUT, "\u0001$1\u0001"), "\u0001")


def german_variants(word: Column) -> Column:
    """All ways to read one or more of the pairs as one letter, by rising bit mask over pairs.

    Empty without a pair, and with more than MOST_PAIRS of them.
    """
    single = F.create_map(*[F.lit(x) for kv in PAIRS.items() for x in kv])
    cut = pieces(word)
    n = ((F.size(cut) - 1) / 2).cast("int")

    def read(mask: Column) -> Column:
        return F.array_join(F.transform(cut, lambda p, i: F.when((i % 2 == 1) & (F.call_function("shiftright", mask, (i / 2).cast("int")) % 2 == 1), F.element_at(single, p)).otherwise(p)), "")

    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 1).cast("int"))
    return F.when(n.between(1, MOST_PAIRS), F.transform(masks, read)).otherwise(F.array().cast("array<string>"))


def python_variants(word: str) -> list[str]:
    """The same for one word on the driver."""
    at, i = [], 0
    while i + 1 < len(word):
        if word[i : i + 2] in PAIRS:
            at.append(i)
            i += 1
        i += 1
    if not 0 < len(at) <= MOST_PAIRS:
        return []
    out = []
    for mask in range(1, 1 << len(at)):
        chosen = {p for k, p in enumerate(at) if mask >> k & 1}
        out.append("".join(PAIRS[word[k : k + 2]] if k in chosen else "" if k - 1 in chosen else word[k] for k in range(len(word))))
    return out
