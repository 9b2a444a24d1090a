"""ARC and WARC records as bytes: writing, reading and converting, without Spark.

ARC, version 1: `URL IP date type length`; version 2: `URL IP date type status checksum location
offset filename length`. A file starts with a version block, `filedesc://name IP date text/plain
length` and in its body the version, its definition of record lines and a blank line; that tells
how later lines are read. A record is its line, as many bytes as it declares, and a line end.

WARC 1.1: named fields, a block of the declared length, two line ends.

Declared lengths alone delimit records. A file may be plain, one gzip member, a member for each record, or
members that begin and end anywhere; `Stream` gives its bytes in order, a chunk at a time. What breaks off, or is
neither a record nor a blank line between two, raises ValueError. The files written here have a member a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

#: Record lines by version, and the profile of revisits.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, LONGEST_LINE = 1 << 16, 1 << 28


def packed(data: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


class Stream:
    """The content of a file in order, unpacked if it is gzip; `at` counts its bytes."""

    def __init__(self, file):
        self.file, self.at = file, 0
        self.raw = file.read(CHUNK)
        self.gzip = self.raw.startswith(b"\x1f\x8b")
        self.engine = None
        self.held, self.place = b"", 0

    def _chunk(self) -> bytes:
        """Some more content, empty at the end."""
        while True:
            data, self.raw = self.raw or self.file.read(CHUNK), b""
            if not self.gzip:
                return data
            if not data:
                if self.engine is not None:
                    raise ValueError("the last gzip member breaks off")
                return b""
            if self.engine is None:
                data = data.lstrip(b"\0")  # some writers pad with zeros
                if not data:
                    continue
                if not data.startswith(b"\x1f"):
                    raise ValueError("bytes after a gzip member that are no member")
            self.engine = self.engine or zlib.decompressobj(31)
            try:
                out = self.engine.decompress(data)
            except zlib.error as e:
                raise ValueError(f"not gzip: {e}") from e
            if self.engine.eof:
                self.raw, self.engine = self.engine.unused_data, None
            if out:
                return out

    def _fill(self) -> bool:
        more = self._chunk()
        self.held, self.place = self.held[self.place :] + more, 0
        return bool(more)

    def line(self) -> bytes | None:
        """A line without its end, None at the end of the content."""
        sought = self.place
        while (end := self.held.find(b"\n", sought)) < 0:
            sought = len(self.held) - self.place
            if sought > LONGEST_LINE:
                raise ValueError("a line without an end")
            if not self._fill():
                if self.place < len(self.held):
                    raise ValueError("a line breaks off")
                return None
        out, self.at = self.held[self.place : end], self.at + end + 1 - self.place
        self.place = end + 1
        return out.removesuffix(b"\r")

    def text(self) -> tuple[int, bytes] | None:
        """(where it starts, the line) of the next line that is not blank."""
        while True:
            at, line = self.at, self.line()
            if line is None or line:
                return None if line is None else (at, line)

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while True:
            part = self.held[self.place : self.place + left]
            parts.append(part)
            left, self.place, self.at = left - len(part), self.place + len(part), self.at + len(part)
            if not left:
                return b"".join(parts)
            if not self._fill():
                raise ValueError(f"{n} bytes declared, {n - left} there")


def clean_url(url: str | None, ident: object) -> str:
    """A URL without white space or control signs, as record lines need it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{ident}"


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 quillspark\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", name]
    return f"{' '.join(head)} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, content: bytes, version: int, name: str, offset: int) -> bytes:
    head = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        head += ["200", hashlib.md5(content).hexdigest(), "-", str(offset), name]
    return f"{' '.join(head)} {len(content)}\n".encode() + content + b"\n"


@dataclass(frozen=True)
class ArcRecord:
    at: int
    version: int
    url: str
    ip: str
    date: str
    kind: str
    status: str | None
    content: bytes

    @property
    def is_http(self) -> bool:
        """An HTTP response; other records (of dns: and the like) are resources as they are."""
        return self.content.startswith(b"HTTP/")


def arc_records(file) -> Iterator[ArcRecord]:
    """The records of an ARC file; files that were joined have a version block each."""
    stream, fields, version = Stream(file), (), 0
    while (found := stream.text()) is not None:
        at, line = found
        if line.startswith(b"filedesc://"):
            body = stream.take(_length(line.rsplit(b" ", 1)[-1], line))
            version = _length(body.split(b" ", 1)[0], body[:40])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            declared = body.split(b"\n")[1].decode().split() if b"\n" in body else []
            fields = tuple(declared) or ARC_FIELDS[version]
            continue
        if not fields:
            raise ValueError("an ARC file starts with its version block")
        # The URL may hold spaces in old files: all other fields are counted from the right.
        values = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in a record line of {len(fields)}")
        got = dict(zip(fields, values, strict=True))
        content = stream.take(_length(got["Archive-length"], line))
        yield ArcRecord(at, version, got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], got.get("Result-code"), content)


def _length(text: bytes | str, line: bytes) -> int:
    try:
        n = int(text)
    except ValueError:
        n = -1
    if n < 0:
        raise ValueError(f"no number where one is declared: {line[:80]!r}")
    return n


def http_response(payload: bytes, page_id: int | None) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers by lower-case name, the head's bytes, the payload).

    Lines end with or without a carriage return, as old servers sent them; a head that no blank line ends has no payload.
    """
    blank = re.search(rb"\r?\n\r?\n", content)
    end = blank.end() if blank else len(content)
    lines = content[: blank.start() if blank else end].decode("latin-1").split("\n")[1:]
    fields = (x.partition(":") for x in lines if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in fields}, content[:end], content[end:]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def record_id(*parts: object) -> str:
    """The same parts give the same identifier, on whichever machine and attempt."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts))).urn}>"


def warc_date(date: str) -> str:
    """14 digits as an ISO date; shorter ones (of old crawlers) get the first moment they allow."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def warc_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; blocks have their declared lengths and digests."""
    stream = Stream(file)
    while (found := stream.text()) is not None:
        if not found[1].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        name = ""
        while line := stream.line():
            text = line.decode()
            if text[0] in " \t" and name:  # a field may go on in the next line
                fields[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.lower()
            fields[name] = value.strip()
        if line is None or "content-length" not in fields:
            raise ValueError("a record without its length")
        block = stream.take(_length(fields["content-length"], found[1]))
        if "warc-block-digest" in fields and sha1(block) != fields["warc-block-digest"]:
            raise ValueError(f"{fields.get('warc-record-id')}: the block does not fit its digest")
        yield fields, block
