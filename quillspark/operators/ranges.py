"""Byte ranges: pattern scans, interval merge, containment."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RANGE, RANGES

#: What is skipped by default, in order. `\\s` and `\\b` are Unicode's.
DEFAULT_SKIP = (
    r"https?://[^\s]+",
    r"#[0-9a-fA-F]{3,8}",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"""(?m)(?:^|[\s"'(\[=<,])\.{0,2}/[^\s]*""",
    r"[A-Za-z]:\\[^\s]*",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z0-9+/]{20,}={1,2}",
    r"\b(?=[a-fA-F]*[0-9])[0-9a-fA-F]{7,40}\b",
    r"\[([^\]]+)\]\([^\s)]+\)",
    r""""[^"\s]*/[^"\s]*"|'[^'\s]*/[^'\s]*'""",
)

#: Bytes of text that are Python objects at a time, with all that is found in them.
SLICE = 1 << 20

_compiled: dict[tuple[str, ...], list] = {}


def compiled(patterns: tuple[str, ...]) -> list:
    """Patterns compiled once in a process; a pattern that is not valid raises on the driver, too."""
    import regex

    if patterns not in _compiled:
        _compiled[patterns] = [regex.compile(p) for p in patterns]
    return _compiled[patterns]


def byte_offsets(text: str) -> list[int] | range:
    """The byte each character starts at, and the end."""
    if text.isascii():
        return range(len(text) + 1)
    out, at = [0], 0
    for c in text:
        at += len(c.encode())
        out.append(at)
    return out


def scan(text: str, patterns: tuple[str, ...]) -> list[tuple[int, int]]:
    """Byte ranges of all matches of all patterns, merged; ranges that touch become one."""
    found = sorted(m.span() for p in compiled(patterns) for m in p.finditer(text))
    if not found:
        return []
    at, out = byte_offsets(text), []
    for start, end in found:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(at[a], at[b]) for a, b in out]


def listed(rows: list[list[tuple]], fields: T.StructType) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs."""
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in fields]
    structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields.names)
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), structs)


def sliced(run: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """An Arrow function whose first column is texts, called for slices of a batch of about SLICE bytes, or one row.

    A batch has thousands of rows, and each word found in them is objects of some hundred bytes; only Arrow's arrays of these stay.
    """

    @functools.wraps(run)
    def each(*columns: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE)) + 1).tolist(), len(sizes)]
        return pa.concat_arrays([run(*[c.slice(a, b - a) for c in columns]) for a, b in itertools.pairwise(cuts)])

    return each


def skip_ranges(text: Column, patterns: tuple[str, ...] = DEFAULT_SKIP, user: tuple[str, ...] = ()) -> Column:
    """An array of merged ranges; `user` patterns come after the defaults, with ^ and $ at lines."""
    every = (*patterns, *(f"(?m){p}" for p in user))
    compiled(every)

    @F.arrow_udf(RANGES)
    @sliced
    def run(texts: pa.Array) -> pa.Array:
        return listed([scan(x, every) if x else [] for x in texts.to_pylist()], RANGE)

    return run(text)


def merged(ranges: Column) -> Column:
    """The union of an array of ranges as disjoint ranges in order; those that touch become one."""
    empty = F.array().cast(RANGES)

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start_byte"].alias("start_byte"), F.greatest(last["end_byte"], r["end_byte"]).alias("end_byte"))))
        return F.when((F.size(acc) > 0) & (r["start_byte"] <= F.try_element_at(acc, F.lit(-1))["end_byte"]), grown).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, step)


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows of intervals -> one row for each run of intervals that overlap or touch."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    numbered = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def inside(start: Column, end: Column, ranges: Column) -> Column:
    """Whether a range lies in one of an array; the array goes along in the row, so nothing is joined."""
    return F.exists(ranges, lambda r: (start >= r["start_byte"]) & (end <= r["end_byte"]))


def outside_join(items: DataFrame, ranges: DataFrame, key: str, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Items that no range of the same key contains, both as tables: an equi anti-join with a residual."""
    r = ranges.select(F.col(key).alias("_key"), F.col("start_byte").alias("_start"), F.col("end_byte").alias("_end"))
    return items.join(r, (F.col(key) == F.col("_key")) & (F.col(start) >= F.col("_start")) & (F.col(end) <= F.col("_end")), "left_anti")
