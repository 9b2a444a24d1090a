"""Reports: places, first occurrences, counters and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import CANDIDATE
from ..sources.stage import staged
from .ranges import listed, sliced

#: Bits of a place in a list of words.
START_BITS = 30
PLACE = T.StructType([*CANDIDATE.fields, T.StructField("line", T.LongType()), T.StructField("col", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("end_col", T.LongType())])


def lines_and_columns(text: str, at: np.ndarray, utf16: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lines and columns from 0 of byte offsets, all in one pass over the text.

    Columns are characters, or UTF-16 units: every byte that begins a character counts, a lead of four bytes twice.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.minimum(at, len(data))
    starts = np.append(0, np.flatnonzero(data == 10) + 1)
    line = np.searchsorted(starts, at, "right") - 1
    if text.isascii():
        return line, at - starts[line]
    units = ((data & 0xC0) != 0x80).astype(np.int64) + ((data >= 0xF0) if utf16 else 0)
    before = np.append(0, np.cumsum(units))
    return line, before[at] - before[starts[line]]


def _located(findings: DataFrame, docs: DataFrame, key: str, keep: tuple[str, ...], utf16: bool) -> DataFrame:
    """(key, keep..., places) with all places of a document in its one row, so each text is read once."""

    @F.arrow_udf(T.ArrayType(PLACE))
    @sliced
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for text, places in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            start, end = (np.array([p[c] for p in places], np.int64) for c in ("start_byte", "end_byte"))
            found = [*lines_and_columns(text, start, utf16), *lines_and_columns(text, end, utf16)]
            rows.append([(p["word"], p["start_byte"], p["end_byte"], *x) for p, x in zip(places, zip(*[f.tolist() for f in found], strict=True), strict=True)])
        return listed(rows, PLACE)

    at = findings.select(key, "word", F.explode("locations").alias("at")).groupBy(key).agg(F.collect_list(F.struct("word", "at.start_byte", "at.end_byte")).alias("places"))
    return at.join(docs.select(key, *keep, "text"), key).select(key, *keep, F.inline(run(F.col("text"), F.col("places"))))


def placed(findings: DataFrame, docs: DataFrame, key: str, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row a place: keep columns, word, start_byte, end_byte, line, col."""
    rows = _located(findings, docs, key, keep, False)
    return rows.select(key, *keep, "word", "start_byte", "end_byte", (F.col("line") + 1).alias("line"), (F.col("col") + 1).alias("col"))


def first_only(places: DataFrame, path: str = "path") -> DataFrame:
    """The first place of each word, in lower case, over all files in path order.

    A minimum, so it combines before the shuffle and no frequent word is ever sorted in one task.
    """
    return places.groupBy(F.lower("word").alias("_word")).agg(F.min(F.struct(path, "start_byte", "word", *[c for c in places.columns if c not in (path, "start_byte", "word")])).alias("f")).select("f.*")


def first_words(docs: DataFrame, least: int = 1) -> DataFrame:
    """(path, words) -> (path, start_byte, word): `first_only` of the words of `least` letters or more, start_byte being their places in the list.

    The least of a structure with strings is found by sorting all rows. So paths are numbered in their order, and a path's number and a
    place are one long, whose least by word as written is hashed: what is shuffled of words is those that a task has, once. Lists have fewer than
    2 ** START_BITS words, as a row is below 2 GB. Rows of one path have one number; a null path comes first.
    """
    spark = docs.sparkSession
    paths = staged(docs.select("path").distinct().orderBy("path").withColumn("_id", F.monotonically_increasing_id()))
    part, bits = F.shiftright("_id", 33), (1 << 33) - 1
    before, total = [(-1, 0)], 0  # of no part, so that there is a row
    for r in paths.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    numbered = paths.withColumn("_part", part).join(offsets, "_part").select(F.col("path").alias("_path"), (F.col("_before") + F.col("_id").bitwiseAND(F.lit(bits))).alias("_number"))
    numbered = staged(numbered)
    rows = docs.join(numbered, F.col("path").eqNullSafe(F.col("_path"))).select("_number", F.posexplode("words").alias("_at", "word")).where(F.char_length("word") >= least)
    code = F.shiftleft("_number", START_BITS) + F.col("_at")
    firsts = rows.groupBy("word").agg(F.min(code).alias("_code"))
    firsts = firsts.select("word", F.shiftright("_code", START_BITS).alias("_number"), F.col("_code").bitwiseAND(F.lit((1 << START_BITS) - 1)).alias("start_byte"))
    return first_only(firsts.join(numbered, "_number").select(F.col("_path").alias("path"), "start_byte", "word"))


def lines(places: DataFrame, path: str = "path", suggestions: DataFrame | None = None) -> DataFrame:
    """(path, start_byte, value): a line for each place, aligned within its file."""
    at = F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string"))
    shown = F.regexp_replace(path, r"^\./", "")
    width = places.groupBy(path).agg(F.max(F.char_length(F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string")))).alias("_width"))
    rows = places.join(width, path)
    if suggestions is not None:
        rows = rows.join(suggestions, "word", "left")
        more = F.coalesce(F.concat(F.lit("  -> "), F.when(F.size("suggestions") > 0, F.array_join("suggestions", ", "))), F.lit(""))
    else:
        more = F.lit("")
    return rows.select(path, "start_byte", F.concat(F.lit("  "), shown, F.lit(":"), F.rpad(at, F.col("_width"), F.lit(" ")), F.lit("  "), F.col("word"), more).alias("value"))


def write_report(report: DataFrame, target: str, path: str = "path") -> None:
    """A text file with each file's name before its lines; ranges of paths are written in parallel."""
    heads = report.select(path).distinct().select(path, F.lit(-1).cast("long").alias("start_byte"), F.regexp_replace(path, r"^\./", "").alias("value"))
    report.select(path, F.col("start_byte").cast("long").alias("start_byte"), "value").unionByName(heads).repartitionByRange(path).sortWithinPartitions(path, "start_byte").select("value").write.mode("overwrite").text(target)


def summary(files: DataFrame, errors: DataFrame) -> DataFrame:
    """files (path, state: checked, ignored, excluded or failed) and places -> one row of counters and an exit status."""
    found = errors.agg(F.count("*").alias("errors"), F.count_distinct("path").alias("files_with_errors"))
    seen = files.agg(
        F.count("*").alias("total"), F.count_if(F.col("state").isin("checked", "failed")).alias("checked"), F.count_if(F.col("state") == "ignored").alias("ignored"),
        F.count_if(F.col("state") == "excluded").alias("excluded"), F.coalesce(F.bool_or(F.col("state") == "failed"), F.lit(False)).alias("failure"),
    )
    both = seen.join(F.broadcast(found))  # one row each
    return both.withColumn("status", F.when(F.col("failure"), 2).when(F.col("errors") > 0, 1).otherwise(0))


def diagnostics(findings: DataFrame, docs: DataFrame, key: str, level: str = "information") -> DataFrame:
    """Places in the editor's coordinates: lines and UTF-16 columns from 0, severity, message."""
    rows = _located(findings, docs, key, (), True)
    return rows.select(key, "word", F.col("line").alias("start_line"), F.col("col").alias("start_col"), "end_line", "end_col", X.severity(F.lit(level)).alias("severity"), F.concat(F.lit("Possible spelling issue '"), "word", F.lit("'.")).alias("message"))


def quick_fixes(places: DataFrame, suggestions: DataFrame, most: int = 5, path: str | None = None) -> DataFrame:
    """places with `actions`: up to `most` replacements, then adding the word to the project's or the global list.

    With the column `path`, the last one is to ignore the file.
    """
    fix = F.transform(F.slice(F.coalesce("suggestions", F.array().cast("array<string>")), 1, most), lambda x: F.struct(F.lit("replace").alias("action"), x.alias("text")))
    adds = F.array(*[F.struct(F.lit(a).alias("action"), F.col("word").alias("text")) for a in ("add_to_project", "add_to_global")])
    if path is not None:
        adds = F.concat(adds, F.array(F.struct(F.lit("ignore_file").alias("action"), F.col(path).alias("text"))))
    return places.join(suggestions, "word", "left").withColumn("actions", F.concat(fix, adds)).drop("suggestions")


def ordered(findings: DataFrame, key: str) -> DataFrame:
    """Findings by first place."""
    return findings.withColumn("_at", F.element_at("locations", 1)["start_byte"]).orderBy(key, "_at").drop("_at")


def top(counts: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The `most` first of each group by falling count, ties by word."""
    window = Window.partitionBy(*by).orderBy(F.desc(order), "word")
    return counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)
