"""Binary files in the shared folder, written by tasks.

Spark's own sinks write rows; archives and coded ids have formats of their own. A task writes
`<name>-<attempt>.<ext>` beside other attempts' files by pyarrow's file systems (file, hdfs, s3 and
others by the folder's URI) and returns a row with the name. Rows of failed or doubled attempts
are never committed, so the table of returned rows names each part's one file, whatever else a
lost executor left behind.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import TaskContext


def task_name(prefix: str, ext: str) -> str:
    context = TaskContext.get()
    part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
    return f"{prefix}-{part:05d}-{attempt}-{uuid.uuid4().hex[:8]}.{ext}"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@contextmanager
def writing(folder: str, name: str):
    """A binary stream; the file has its name only once it is whole."""
    store, at = _open(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/.{name}.part", compression=None) as out:
        yield out
    store.move(f"{at}/.{name}.part", f"{at}/{name}")


@contextmanager
def reading(folder: str, name: str):
    """A binary file with random access."""
    store, at = _open(folder)
    with store.open_input_file(f"{at}/{name}") as file:
        yield file


def read_columns(paths: tuple[str, ...], columns: list[str]):
    """Columns of the Parquet files of a table in the shared folder, as one Arrow table."""
    import pyarrow as pa
    from pyarrow import parquet

    found = []
    for path in paths:
        store, at = _open(path)
        found.append(parquet.read_table(at, columns=columns, filesystem=store))
    return pa.concat_tables(found)
