"""Marks of known keys in a bit set of bounded size, which leave out most other keys before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that keys of known words are marked in, to leave out other keys of the words asked. A row has ROW longs of them, so the
#: broadcast has 131,072 rows at most and about 25 MB, whatever the lexicon.
BITS, ROW = 1 << 27, 16


def known_by_bits(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of left whose `_cut` may be one of right's: its bit is set, as are those of a few others."""
    place = F.pmod("_cut", F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    word, row = (F.floor(place / 64) % ROW).cast("int"), F.floor(place / (64 * ROW))
    held = F.array(*[F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("long")) for k in range(ROW)])
    marks = right.groupBy(row.alias("_row")).agg(held.alias("_bits"))
    return left.withColumn("_row", row).join(F.broadcast(marks), "_row").where(F.get("_bits", word).bitwiseAND(bit) != 0).drop("_row", "_bits")
