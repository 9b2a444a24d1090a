"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset (tests in one JVM) a folder of this process."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-stage-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def own_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is there goes when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    path = f"{re.sub('^file:/+', 'file:///', whole)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, written once and read again, so it outlives lost executors and keeps its columns."""
    path = own_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clear() -> None:
    """Spark may have stopped already, so pyarrow deletes."""
    from pyarrow import ArrowException, fs

    for path in _made:
        with contextlib.suppress(OSError, ArrowException):
            store, at = fs.FileSystem.from_uri(path)
            store.delete_dir(at)
