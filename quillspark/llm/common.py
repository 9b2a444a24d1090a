"""What the operators of this subpackage share: tables, words and staged results."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as a class body for Java and RE2, and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE = " \t\n\x0b\x0c\r"

#: Shuffle partitions that one task of `staged_ids` writes, about.
SHARED = 8

_own_root: str | None = None
_staged: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset (tests in one JVM) a
    temporary folder of this process serves, and goes with it.
    """
    global _own_root
    if found := spark.conf.get("spark.checkpoint.dir", None):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        return re.sub("^file:/+", "file:///", whole)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_root is None or not os.path.isdir(_own_root):
        _own_root = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    The written copy cuts the lineage and outlives lost executors, and what made it runs once
    however often the result is read. It goes when the application's driver ends.
    """
    path = fresh_dir(df.sparkSession, name)
    if not _staged:
        atexit.register(_clear)
    _staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_ids(df: DataFrame, name: str) -> DataFrame:
    """`staged` for rows of a few numbers each: a task writes several shuffle partitions into one file.

    Files are fewer by this factor and no fewer than the cores, so a task's part shrinks with more partitions.
    """
    spark = df.sparkSession
    files = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARED)
    return staged(df.coalesce(files), name)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged inside go at the end, but for those made by the function it gives."""
    start, kept = len(_staged), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        kept.add(_staged[-1])
        return out

    yield keep
    for path in [p for p in _staged[start:] if p not in kept]:
        drop_dir(spark, path)
        _staged.remove(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Batches of at most so many rows for what runs inside: executors and workers hold a batch each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _clear() -> None:
    """Delete this driver's staged tables; Spark may have stopped already, so by pyarrow."""
    from pyarrow import fs

    for path in _staged:
        with contextlib.suppress(OSError, pa.ArrowException):
            store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            store.delete_dir(at)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a staged folder by Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def own_texts(column: pa.Array) -> pa.Array:
    """A column's texts as large strings in buffers of their own; null is empty.

    Arrow's string functions misread large strings cast from a slice, whose offsets start above 0.
    """
    return pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")


def give_back() -> None:
    """Return freed memory to the system: workers outlive tasks, and what they hold is no one else's.

    Python's and Arrow's allocators keep what a batch needed at its peak. Where the C library is
    another one, this does less.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; all else stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
