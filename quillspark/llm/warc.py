"""Pages to legacy archives, these to WARC, and back to rows.

`write_arc` writes pages as ARC files, of version 1 and 2 by turns. `convert` parses these by their
version's record lines and declared lengths, whether they are plain or gzip and wherever its members end,
and writes WARC files: identifiers from what a record says (so a repeated task gives the same), ISO timestamps,
SHA-1 digests, and types. What is no HTTP response (dns: records and the like) is a resource, its whole content the
block. Of responses with equal payloads of `SMALL` bytes or more, the one with the largest page_id (of rows that
repeat it, the last by file and place) is a response and others are revisits that refer to it.
`read_warc_files` reads and checks the records.

Payloads are in files only: tables carry digests and places, so a payload that a third of all
pages share is one row after partial aggregation, and the join that tells its copies apart moves a
hundred bytes a page. Files roll at `FILE_BYTES` of content; tasks hold a record at a time.

A null html is an empty payload, a null url is `urn:page:<page_id>`; a null page_id comes back as
null and counts as the smallest. Rows that repeat are records each. Payloads of any length are whole; columns
other than page_id, url and html are not read. An empty table gives no files and no rows. A file that breaks off
or is no ARC raises ValueError.
"""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive as A
from . import files
from .common import fresh_dir, staged, table

SMALL = 1000
FILE_BYTES = 1 << 26
_EPOCH = datetime.datetime(2024, 1, 1)


def crawl_date(page_id: int | None) -> str:
    """Pages have no date; their ids give one, a second apart."""
    return (_EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")


class _Rolling:
    """Files of a task, a new one after FILE_BYTES; `done` has (name, records)."""

    def __init__(self, folder: str, prefix: str, ext: str, first):
        self.folder, self.prefix, self.ext, self.first = folder, prefix, ext, first
        self.done: list[tuple[str, int]] = []
        self.open = None

    def _close(self) -> None:
        if self.open:
            self.done.append((self.name, self.n))
            self.open.__exit__(None, None, None)
            self.open = None

    def add(self, make) -> None:
        """make(name, offset) gives a record's bytes."""
        if not self.open:
            self.name = files.task_name(f"{self.prefix}-{len(self.done):04d}", self.ext)
            self.open = files.writing(self.folder, self.name)
            self.out, self.n, self.size, self.at = self.open.__enter__(), 0, 0, 0
            self._put(self.first(self.name))
        self._put(make(self.name, self.at))
        self.n += 1
        if self.size >= FILE_BYTES:
            self._close()

    def _put(self, record: bytes) -> None:
        data = A.packed(record)
        self.out.write(data)
        self.at += len(data)
        self.size += len(record)

    def manifest(self) -> pa.RecordBatch:
        self._close()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in self.done], pa.string()), pa.array([x[1] for x in self.done], pa.int64())], names=["file", "records"])


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html) -> manifest (file, records) of ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        out = _Rolling(folder, "pages", "arc.gz", lambda name: A.arc_version_block(name, version, crawl_date(0)))
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html = (batch.column(c)[k].as_py() for c in range(3))
                content = A.http_response((html or "").encode(), page_id)
                out.add(lambda name, at, page_id=page_id, url=url, content=content: A.arc_record(A.clean_url(url, page_id), crawl_date(page_id), content, version, name, at))
        yield out.manifest()

    return staged(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string, records long"), "arc-manifest")


INDEX = "file string, at long, kind string, page_id long, url string, date string, digest string, payload_bytes long"


def arc_index(manifest: DataFrame, folder: str, n_files: int) -> DataFrame:
    """(file) -> a row for each ARC record: where it is, and what WARC needs to know of it."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.reading(folder, name) as file:
                    for record in A.arc_records(file):
                        head, _, payload = A.http_parts(record.content) if record.is_http else ({}, b"", record.content)
                        page_id = head.get("x-page-id")
                        rows.append({"file": name, "at": record.at, "kind": "response" if record.is_http else "resource", "page_id": int(page_id) if page_id and re.fullmatch("-?[0-9]{1,18}", page_id) else None, "url": record.url, "date": record.date, "digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return staged(manifest.select("file").repartition(max(1, n_files)).mapInArrow(run, INDEX), "arc-index")


def typed(index: DataFrame, small: int = SMALL) -> DataFrame:
    """index with `response`, the record that a revisit refers to, null for responses."""
    large = index.where((F.col("payload_bytes") >= small) & (F.col("kind") == "response"))
    last = F.max(F.struct("page_id", "file", "at", "url", "date"))
    shared = large.groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), last.alias("response")).where("n > 1").select(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"), F.lit("response").alias("k"), "response")
    both = index.join(shared, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")) & (F.col("kind") == F.col("k")), "left").drop("d", "b", "k")
    self_ = (F.col("response.file") == F.col("file")) & (F.col("response.at") == F.col("at"))
    return both.withColumn("response", F.when(~self_, F.col("response")))


def convert(rows: DataFrame, arc_folder: str, folder: str, n_files: int) -> DataFrame:
    """Typed index rows -> manifest of WARC files; a task has whole ARC files, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def info(name: str) -> bytes:
            block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
            return A.warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", A.record_id(name)), ("WARC-Date", A.warc_date(crawl_date(0))), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)

        out, now = _Rolling(folder, "pages", "warc.gz", info), None
        with contextlib.ExitStack() as opened:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["file"] != now:
                        opened.close()
                        now, records = row["file"], A.arc_records(opened.enter_context(files.reading(arc_folder, row["file"])))
                    # The index has all records of the file, in its order.
                    record = next(r for r in records if r.at == row["at"])
                    out.add(lambda name, at, record=record, row=row: _warc(record, row))
        yield out.manifest()

    ordered = rows.repartition(max(1, n_files), "file").sortWithinPartitions("file", "at")
    return staged(ordered.mapInArrow(run, "file string, records long"), "warc-manifest")


def _warc(record: A.ArcRecord, row: dict) -> bytes:
    _, head, payload = A.http_parts(record.content) if record.is_http else ({}, b"", record.content)
    ident = lambda r, digest: A.record_id(r["url"], r["date"], r["page_id"], r["file"], r["at"], digest)
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", ident(row, row["digest"])), ("WARC-Date", A.warc_date(record.date)),
        ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip), ("WARC-Payload-Digest", A.sha1(payload)), ("Content-Type", "application/http;msgtype=response"),
    ]
    target = row["response"]
    if not record.is_http:
        fields[0], fields[-1] = ("WARC-Type", "resource"), ("Content-Type", record.kind)
    if target is None:
        return A.warc_record(fields, record.content)
    fields[0] = ("WARC-Type", "revisit")
    fields += [("WARC-Profile", A.PROFILE), ("WARC-Refers-To", ident(target, row["digest"])), ("WARC-Refers-To-Target-URI", target["url"]), ("WARC-Refers-To-Date", A.warc_date(target["date"]))]
    if target["page_id"] is not None:
        fields.append(("X-Refers-To-Page-Id", str(target["page_id"])))
    return A.warc_record(fields, head)


def read_warc_files(manifest: DataFrame, folder: str, n_files: int) -> DataFrame:
    """Rows of the response, revisit and resource records; digests of payloads are checked."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string())])

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.reading(folder, name) as file:
                    for fields, block in A.warc_records(file):
                        kind = fields["warc-type"]
                        if kind in ("response", "revisit", "resource"):
                            head, _, payload = A.http_parts(block) if kind != "resource" else ({}, b"", block)
                            if kind != "revisit" and A.sha1(payload) != fields["warc-payload-digest"]:
                                raise ValueError(f"{fields['warc-record-id']}: the payload does not fit its digest")
                            size = int(head.get("content-length", len(payload))) if kind == "revisit" else len(payload)
                            rows.append({"page_id": number(head.get("x-page-id")), "payload_bytes": size, "payload_digest": A.hex_digest(fields["warc-payload-digest"]), "record_type": kind, "refers_to": number(fields.get("x-refers-to-page-id")), "record_id": fields["warc-record-id"], "url": fields["warc-target-uri"]})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("file").repartition(max(1, n_files)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")


def converted(manifest: DataFrame, arc_folder: str) -> DataFrame:
    """ARC files (file) of a folder, converted to WARC and read back."""
    warc, n = fresh_dir(manifest.sparkSession, "warc"), manifest.count()
    written = convert(typed(arc_index(manifest, arc_folder, n)), arc_folder, warc, n)
    return read_warc_files(written, warc, written.count())


def converted_pages(pages: DataFrame) -> DataFrame:
    """Write pages as ARC, convert to WARC, read the WARC files back."""
    arc = fresh_dir(pages.sparkSession, "arc")
    return converted(write_arc(pages, arc), arc)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted_pages(table(spark, sf_dir, "pages")).drop("record_id", "url")


OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS response FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM r
"""

QUERIES = {"op4_arc_to_warc": op4_arc_to_warc}
SQL = {"op4_arc_to_warc": OP4_SQL}
