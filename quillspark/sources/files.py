"""Files as documents: path patterns, directory walks with ignore files, UTF-8 reads."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.policy import Settings, SettingsError, glob_regex, path_matches
from ..plans.registry import resolve
from ..schema import DOCUMENT

IGNORE_FILES = (".gitignore", ".ignore")


def ignore_rule(line: str, base: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over relative paths, negated, directories only) of a line of an ignore file."""
    line = line.rstrip("\n")
    if not line.strip() or line.startswith("#"):
        return None
    body = line.rstrip() if not line.endswith("\\ ") else line
    negated = body.startswith("!")
    body = body[1:] if negated else body
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            out.append(f"[{body[i + 1 : end].replace('!', '^', 1) if body[i + 1] == '!' else body[i + 1 : end]}]")
            i = end + 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])))
            i += 1
    lead = re.escape(base + "/") if base else ""
    return re.compile(f"^{lead}{'' if anchored else '(?:.*/)?'}{''.join(out)}$"), negated, only_dirs


def walk(root: Path) -> list[Path]:
    """Files below a directory: no hidden entries, no links followed, nested ignore files heeded."""
    out: list[Path] = []

    def visit(folder: Path, rules: list) -> None:
        own = list(rules)
        base = folder.relative_to(root).as_posix()
        for name in IGNORE_FILES:
            if (folder / name).is_file():
                lines = (folder / name).read_text(encoding="utf-8", errors="replace").splitlines()
                own += [r for r in (ignore_rule(x, "" if base == "." else base) for x in lines) if r]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name.startswith("."):
                continue
            relative = (Path(entry.path)).relative_to(root).as_posix()
            is_dir = entry.is_dir(follow_symlinks=False)
            ignored = False
            for pattern, negated, only_dirs in own:
                if (is_dir or not only_dirs) and pattern.match(relative):
                    ignored = not negated
            if ignored:
                continue
            if is_dir:
                visit(Path(entry.path), own)
            elif entry.is_file(follow_symlinks=False):
                out.append(Path(entry.path))

    visit(root, [])
    return out


def resolve_paths(patterns: list[str], root: str | Path) -> tuple[list[str], bool]:
    """Directories are walked, files are themselves, others are globs from the root.

    (paths in order and once each, whether a pattern was invalid or matched nothing)
    """
    root = Path(root).resolve()
    found: set[str] = set()
    failed = False
    for pattern in patterns:
        path = root / pattern
        if path.is_dir():
            found.update(map(str, walk(path)))
        elif path.is_file():
            found.add(str(path))
        else:
            try:
                rule = re.compile(glob_regex(pattern.removeprefix("./")))
            except SettingsError:
                failed = True
                continue
            hits = [str(p) for p in walk(root) if rule.match(p.relative_to(root).as_posix())]
            failed |= not hits
            found.update(hits)
    return sorted(found), failed


def relative_to(path: Column, root: str) -> Column:
    """Below the root, the part after it; else the path as it is."""
    lead = root.rstrip("/") + "/"
    return F.when(path.startswith(lead), F.substr(path, F.lit(len(lead) + 1))).otherwise(path)


def read_files(spark: SparkSession, paths: list[str], root: str | None = None) -> DataFrame:
    """(path, text, state) of files; those that are no UTF-8 have no text and count as clean.

    A file that cannot be read is `failed` and the others go on. Paths may be URIs of any store that pyarrow reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                text, state = None, "checked"
                try:
                    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    with store.open_input_stream(at, compression=None) as file:
                        text = file.read().decode("utf-8")
                except UnicodeDecodeError:
                    pass
                except OSError:
                    state = "failed"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([state])], names=["path", "text", "state"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    read = spread(rows).mapInArrow(run, "path string, text string, state string")
    return read.select((relative_to(F.col("path"), root) if root else F.col("path")).alias("path"), "text", "state")


def read_tree(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """All files below a folder of any store that Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(good, F.col("content").cast("string")).alias("text"), F.lit("checked").alias("state"))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, at least.

    A small table may be one unsplittable file; then the work on its texts is worth a shuffle. A table of many
    files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def one_text(spark: SparkSession, text: str, language: str | None = None, path: str | None = None) -> DataFrame:
    return spark.createDataFrame([(0, path, language, text)], DOCUMENT)


def admitted(files: DataFrame, settings: Settings, path: str = "path") -> DataFrame:
    """files with `state`: ignored before anything else, excluded if nothing includes them."""
    state = F.when(path_matches(F.col(path), settings.ignore_paths), "ignored")
    if settings.include_paths:
        state = state.when(~path_matches(F.col(path), settings.include_paths), "excluded")
    return files.withColumn("state", state.otherwise(F.col("state") if "state" in files.columns else F.lit("checked")))


def with_language(docs: DataFrame, language: str = "language", path: str = "path") -> DataFrame:
    return docs.withColumn("language", resolve(F.col(language) if language in docs.columns else F.lit(None).cast("string"), F.col(path) if path in docs.columns else F.lit(None).cast("string")))


def init_options(payload: Column) -> Column:
    """Editor options from JSON, with defaults for what is missing or malformed."""
    parsed = F.from_json(payload, "checkWhileTyping boolean, diagnosticSeverity string, logLevel string, globalConfigPath string")
    return F.struct(
        F.coalesce(parsed["checkWhileTyping"], F.lit(True)).alias("check_while_typing"), F.coalesce(F.lower(parsed["diagnosticSeverity"]), F.lit("information")).alias("severity"),
        F.coalesce(F.lower(parsed["logLevel"]), F.lit("info")).alias("log_level"), parsed["globalConfigPath"].alias("global_config"),
    )
