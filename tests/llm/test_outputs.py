"""Token files, archives, pseudonyms, licences and the pipeline."""

import datetime
import hashlib
import io
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import archive, files, huffman, licences, pii, tokens, warc

TRICKY = ["", " ", "a", "\n", "a\nb", "a \nb", "a\n b", "  a", "a  b", "a\t b", "a <|endoftext|> b", "x  <|endoftext|>", "a b ", "é　 c", "don't I'm\r\n ok", "a\n\nb", "\nabc", "a\x1c b", "a², b!.c d.. e., f", "日本語 テキスト", "Word, word. WORD! 123 456,7", "nul\x00 in"]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 3000
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=3000)))
    cuts = np.sort(rng.integers(0, n + 1, 9))
    units = np.diff(np.concatenate([[0], cuts, [n]]))
    data, first, marks = code.encode(ids, units)
    assert (code.decode(data, first, units, marks) == ids).all()


def test_huffman_lengths_are_limited_prefix_free_and_optimal():
    counts = np.array([1 << k for k in range(30)] + [0, 0])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8 and (lengths[-2:] == 0).all()
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    codes = huffman.canonical_codes(lengths)
    texts = sorted(format(int(c), f"0{n}b") for c, n in zip(codes, lengths) if n)
    assert not any(b.startswith(a) for a, b in zip(texts, texts[1:]))
    plain = np.random.default_rng(0).integers(1, 100, 200)
    assert huffman.mean_bits(plain, huffman.code_lengths(plain)) == pytest.approx(huffman.unlimited_mean_bits(plain))
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    whole, own = Tokenizer.from_file(path), tokens.PieceEncoder(path, most=3)
    texts = TRICKY + [f"{a} {b}\n{a}, {b}." for a in TRICKY for b in TRICKY[::3]]
    for column in (pa.array(texts), pa.array([*TRICKY, *texts]).slice(len(TRICKY))):
        ids, n = own(column)
        at = 0
        for text, size in zip(texts, n):
            assert ids[at : at + size].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text
            at += size


def test_token_files_return_what_the_tokenizer_gives(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK", 512)
    monkeypatch.setattr(tokens, "IDS_PER_FILE", 3000)
    rows = [(1000 - k, t, 1) for k, t in enumerate(TRICKY * 3)] + [(5, None, 1), (5, "again", 1), (6, "lange Zeile " * 2000, 1)]
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5)
    got = sorted(map(tuple, tokens.op9_token_files(spark, "", df).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: (r[1]))
    ids = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, _ in rows]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert Counter((g[0], g[2], g[3]) for g in got) == want
    assert [g[0] for g in got] == sorted(g[0] for g in got)
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])])[:-1].tolist()
    assert tokens.op9_token_files(spark, "", df.limit(0)).count() == 0


def test_documents_of_one_id_fill_many_files(spark, monkeypatch):
    """Very many rows without an id, and with one: they are dealt to files like others, in one order."""
    monkeypatch.setattr(tokens, "IDS_PER_FILE", 200)
    rows = [(None if k % 3 else 7, f"word{k} " * (1 + k % 20)) for k in range(300)] + [(9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest, folder = tokens.token_files(df, tokens.default_tokenizer())
    files_ = manifest.orderBy("start").collect()
    assert len(files_) > 15 and max(f.n_ids for f in files_) < 0.2 * sum(f.n_ids for f in files_)
    got = sorted(map(tuple, tokens.read_files(manifest, folder, len(files_)).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [None] * 200 + [7] * 100 + [9]
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])])[:-1].tolist()


def test_blocks_read_by_themselves(tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 300)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50, 2000)
    with files.writing(str(tmp_path), "x.qhuf") as out:
        writer = tokens.FileWriter(out, huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=60))))
        writer.add(pa.array([3, None]), np.array([1500, 500]), ids)
        writer.close()
    with files.reading(str(tmp_path), "x.qhuf") as file:
        reader = tokens.FileReader(file)
        assert (reader.ids(4) == ids[1200:1500]).all()
        assert [d[:2] for d in reader.documents()] == [(3, 1500), (None, 500)]


def pages():
    big, small = "<p>" + "ä" * 600 + "</p>", "<p>small</p>"
    return [(1, "http://a/x y", big), (2, "http://b", big), (7, None, big), (7, "http://b", big), (3, "", small), (4, "http://d", small), (5, "http://e", None), (6, "http://f", ""), (None, "http://g", "z" * 2000), (8, "http://h\n", "GET\r\n\r\nWARC/1.1\r\n\r\n" * 100), (9, "http://i", "q" * 1000), (10, "http://j", "q" * 1000), (11, "http://k", "q" * 999), (12, "http://l", "q" * 999)]


def test_pages_come_back_from_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    rows = warc.converted_pages(df).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    from hashlib import sha1

    by = {}
    for i, _, html in pages():
        by.setdefault((html or "").encode(), []).append(i)
    want = Counter()
    for payload, ids in by.items():
        keep = max(ids, key=lambda i: -1 if i is None else i)
        first = True
        for i in sorted(ids, key=lambda i: -1 if i is None else i, reverse=True):
            revisit = len(payload) >= 1000 and not first
            want[i, len(payload), sha1(payload).hexdigest(), "revisit" if revisit else "response", keep if revisit else None] += 1
            first = False
    assert got == want
    assert len({r.record_id for r in rows}) == len(rows)
    assert warc.converted_pages(df.limit(0)).count() == 0


def test_archive_conversion_equals_its_sql(spark, tmp_path):
    rows = [r for r in pages() if r[0] is not None and r[1:2] != (None,)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = warc.op4_arc_to_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    found = con.execute(warc.OP4_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(found)


def layouts(parts):
    """The same content as files: plain, one member, a member a part, and members that end anywhere."""
    whole = b"".join(parts)
    cuts = [0, 1, len(whole) // 3, len(whole) // 2 + 1, len(whole)]
    return {"plain": whole, "whole": archive.packed(whole), "each": b"".join(map(archive.packed, parts)), "anywhere": b"".join(archive.packed(whole[i:j]) for i, j in zip(cuts, cuts[1:])) + b"\0" * 9}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version, monkeypatch):
    monkeypatch.setattr(archive, "CHUNK", 7)
    body = b"HTTP/1.1 200 OK\r\n\r\nbody\n\n"
    head = archive.arc_version_block("f.arc", version, "2024")
    parts = [head, archive.arc_record("http://a/b c", "20240102030405", body, version, "f.arc", 9), archive.arc_record("http://e", "2024", b"", version, "f.arc", 9), archive.arc_record("dns:a.org", "2024", b"20240101 1.2.3.4\n", version, "f", 0)]
    for layout, data in layouts(parts + [head] + parts[1:2]).items():
        got = list(archive.arc_records(io.BytesIO(data)))
        assert [(r.url, r.date, r.content, r.is_http) for r in got] == [("http://a/b c", "20240102030405", body, True), ("http://e", "2024", b"", False), ("dns:a.org", "2024", b"20240101 1.2.3.4\n", False), ("http://a/b c", "20240102030405", body, True)], layout
        assert {r.status for r in got} == {"200" if version == 2 else None}
        assert len({r.at for r in got}) == 4
        with pytest.raises(ValueError):
            list(archive.arc_records(io.BytesIO(data[: -12 if layout == "anywhere" else -9])))
    with pytest.raises(ValueError, match="declared"):
        list(archive.arc_records(io.BytesIO(head + archive.arc_record("http://a/b", "2024", b"0123456789", version, "f", 0)[:-5])))
    with pytest.raises(ValueError, match="version block"):
        list(archive.arc_records(io.BytesIO(b"http://a 0 2024 text/html 0\n")))
    with pytest.raises(ValueError, match="no number"):
        list(archive.arc_records(io.BytesIO(head + archive.arc_record("http://a", "2024", b"", version, "f", 0).replace(b" 0\n", b" -1\n"))))
    with pytest.raises(ValueError, match="after a gzip member"):
        list(archive.arc_records(io.BytesIO(archive.packed(head) + b"more")))
    assert list(archive.arc_records(io.BytesIO(b""))) == []
    assert archive.warc_date("2024") == "2024-01-01T00:00:00Z" and archive.warc_date("20240203040506") == "2024-02-03T04:05:06Z"


def test_warc_records_in_every_layout(monkeypatch):
    monkeypatch.setattr(archive, "CHUNK", 7)
    blocks = [b"one\r\n\r\nWARC/1.1\r\n" * 50, b"", b"three"]
    parts = [archive.warc_record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{k}>"), ("Note", "a\r\n b")], b) for k, b in enumerate(blocks)]
    for layout, data in layouts(parts).items():
        got = list(archive.warc_records(io.BytesIO(data)))
        assert [b for _, b in got] == blocks and got[0][0]["note"] == "a b", layout
        with pytest.raises(ValueError):
            list(archive.warc_records(io.BytesIO(data[: -12 if layout == "anywhere" else -7])))
    with pytest.raises(ValueError, match="digest"):
        list(archive.warc_records(io.BytesIO(parts[2].replace(b"three", b"threE"))))


def test_archives_of_others_are_converted(spark, tmp_path):
    """ARC files in all layouts and both versions, with dns records: types, identifiers and digests."""
    rows = []
    for version in (1, 2):
        page = archive.http_response(b"p" * 1500, version)
        parts = [archive.arc_version_block("x", version, "2003"), archive.arc_record("dns:a.org", "20030101", b"20030101 1.2.3.4\n" * 90, version, "x", 0), archive.arc_record("http://a.org", "20030102", page, version, "x", 0)]
        for layout, data in layouts(parts).items():
            name = f"{layout}-{version}.arc"
            (tmp_path / name).write_bytes(data)
            rows.append((name,))
    got = warc.converted(spark.createDataFrame(rows, "file string"), f"file://{tmp_path}").collect()
    kinds = Counter((r.record_type, r.payload_bytes, r.refers_to) for r in got)
    assert kinds == {("resource", 1530, None): 8, ("response", 1500, None): 1, ("revisit", 1500, 2): 7}
    assert len({r.record_id for r in got}) == 16


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["call +1 (743) 555-3824 or (743) 555-3824, +1 (017) 555-0000", "card 4111 1111 1111 1111, 4111111111111111; bad 4111111111111112 and 9111111111111111", "ip 192.168.1.1, 300.1.1.1, 1.2.3.4.5", "2024-02-29 29.02.2024 29/02/2024 2023-02-29 13/13/2020", "123-45-6789 000-12-3456 666-12-3456", "Mail a.b9@Mail1.example.com or x@y.org.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', "own \x01 mark \x01\x03 2024-01-01", "", None, "no value", "4111111111111111$$$", "4" * 40, "x" * 100000 + " 10.0.0.1"]
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.pseudonymised(df, "key").collect()}
    kinds = {k: [f.kind for f in r.found] for k, r in got.items()}
    values = {k: [f.text for f in r.found] for k, r in got.items()}
    assert kinds == {0: ["phone"] * 3, 1: ["card"] * 2, 2: ["ip"], 3: ["date"] * 3, 4: ["ssn"], 5: ["email"] * 2, 6: ["secret"], 7: ["date"], 8: [], 9: [], 10: [], 11: ["card"], 12: [], 13: ["ip"]}
    digits = lambda x: "".join(c for c in x if c.isdigit())
    assert digits(values[0][0]) == "1" + digits(values[0][1]) and values[0][2].startswith("+1 (")
    assert digits(values[1][0]) == values[1][1] == values[11][0] and luhn(values[1][1]) and values[1][1] != "4111111111111111"
    assert values[1][0].count(" ") == 3 and "4111111111111112" in got[1].text and "9111111111111111" in got[1].text
    assert all(0 <= int(x) < 256 for x in values[2][0].split(".")) and "300.1.1.1, 1.2.3.4.5" in got[2].text
    y, m, d = values[3][0].split("-")
    assert values[3][1:] == [f"{d}.{m}.{y}", f"{d}/{m}/{y}"] and "2023-02-29 13/13/2020" in got[3].text
    assert values[5][0].endswith(".example.com") and values[5][0].count("@") == 1 and got[5].text.endswith(".")
    assert len(values[6][0]) == len('token = ""') + 40 and got[6].text.endswith('"###')
    assert got[7].text.startswith("own \x01 mark \x01\x03 ") and got[9].text is None and got[8].text == "" and got[12].text == "4" * 40
    assert all(r.kind == "kept" for r in got.values())
    other = pii.pseudonymised(df.where("doc_id = 2"), "other key").first().found[0].text
    assert other != values[2][0]


def plain_feistel(values, radices, kind, key):
    half = len(values) // 2
    for k in range(8):
        other = values[half:] if k % 2 == 0 else values[:half]
        text = f"{key}|{kind}|{k}|[{', '.join(map(str, other))}]"
        hexed = [hashlib.sha512((text + (f"|{b}" if b else "")).encode()).hexdigest() for b in range(len(values) // 24 + 1)]
        move = lambda i: int(hexed[i // 24][i % 24 * 5 :][:5], 16)
        values = [(v + move(i)) % radices[i] if (k % 2 == 0) == (i < half) else v for i, v in enumerate(values)]
    return values


def plain_pseudonym(kind, x, key):
    """A value's pseudonym by plain Python, None if it is not valid."""
    digits = [int(c) for c in x if c.isdigit()]

    def filled(new):
        left = iter(new)
        return "".join(str(next(left)) if c.isdigit() else c for c in x)

    def moved(own, low, radices):
        return [v + b for v, b in zip(plain_feistel([v - b for v, b in zip(own, low)], radices, kind, key), low)]

    def classed(text):
        of = lambda c: (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)
        return "".join(map(chr, moved([ord(c) for c in text], [of(c)[0] for c in text], [of(c)[1] for c in text])))

    if kind == "card":
        if not luhn("".join(map(str, digits))):
            return None
        body = moved(digits[:-1], [2] + [0] * (len(digits) - 2), [5] + [10] * (len(digits) - 2))
        return filled(body + [next(d for d in range(10) if luhn("".join(map(str, body)) + str(d)))])
    if kind == "phone":
        own = digits[-10:]
        low = [2 if i in (0, 3) and v >= 2 else 0 for i, v in enumerate(own)]
        return filled(digits[:-10] + moved(own, low, [10 if i not in (0, 3) else 8 if v >= 2 else 2 for i, v in enumerate(own)]))
    if kind == "ssn":
        area, group, serial = int(x[:3]), int(x[4:6]), int(x[7:])
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        a, g, n = plain_feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], kind, key)
        return f"{a + (2 if a >= 665 else 1):03d}-{g + 1:02d}-{n + 1:04d}"
    if kind == "ip":
        own = [int(o) for o in x.split(".")]
        return ".".join(map(str, plain_feistel(own, [256] * 4, kind, key))) if max(own) < 256 else None
    if kind == "date":
        form = f"%Y{x[4]}%m{x[4]}%d" if x[4] in "-/" else f"%d{x[2]}%m{x[2]}%Y"
        try:
            n = (datetime.datetime.strptime(x, form).date() - datetime.date(1800, 1, 1)).days
        except ValueError:
            return None
        if not 0 <= n < 146097:
            return None
        a, b = plain_feistel([n // 773, n % 773], [189, 773], kind, key)
        return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)).strftime(form)
    if kind == "email":
        at = x.index(".", x.index("@"))
        return classed(x[:at]) + x[at:]
    value = x[x.index('"') + 1 : -1]
    if all(c in "0123456789abcdef" for c in value):
        return x[: -len(value) - 1] + "".join(f"{v:x}" for v in plain_feistel([int(c, 16) for c in value], [16] * len(value), kind, key)) + '"'
    return x[: -len(value) - 1] + classed(value) + '"'


def test_pseudonyms_against_plain_python(spark):
    """Random values of all kinds, valid and not, held to a second implementation."""
    import re

    rng = np.random.default_rng(12)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(rng.choice(list("abcXYZ019_"), n))
    make = [
        lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"{rng.integers(200, 999)}-{rng.integers(200, 999)}-{d(4)}", lambda: f"{rng.integers(2, 7)}{d(15)}", lambda: f"4{d(3)} {d(4)} {d(4)} {d(4)}", lambda: f"{rng.integers(2, 7)}{d(12)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: ".".join(str(rng.integers(0, 300)) for _ in range(4)), lambda: f"{rng.integers(1700, 2300)}-{rng.integers(1, 14):02d}-{rng.integers(1, 32):02d}",
        lambda: f"{rng.integers(1, 32):02d}.{rng.integers(1, 13):02d}.{rng.integers(1800, 2200)}", lambda: f"{rng.integers(1900, 2100)}/{rng.integers(1, 13):02d}/{rng.integers(1, 29):02d}", lambda: f"{letters(rng.integers(1, 60))}a.b9@Mail{d(2)}.example.com",
        lambda: f'token = "{d(8)}{"".join(rng.choice(list("abcdef0123456789"), rng.integers(0, 60)))}"', lambda: f'API_KEY: "{letters(rng.integers(8, 70))}"', lambda: "words in between",
    ]
    texts = ["; ".join(make[k]() for k in rng.integers(0, len(make), rng.integers(0, 9))) for _ in range(250)] + ["a@b.cc " + "x.y" * 10, 'password="' + "q" * 300 + '"', f"{'u' * 200}@{'h' * 200}.org", None, ""]

    def plain(text):
        found = []

        def one(m):
            kind = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, m[0]))
            new = plain_pseudonym(kind, m[0], "k")
            if new is not None:
                found.append((kind, new))
            return m[0] if new is None else new

        return (re.sub(pii.ANY, one, text) if text else text), found

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_cuts", F.lit("own")).withColumn("found", F.lit("theirs"))
    got = {r.doc_id: r for r in pii.pseudonymised(df, "k").collect()}
    kinds = Counter()
    for k, text in enumerate(texts):
        want, found = plain(text)
        assert (got[k].text, [tuple(f) for f in got[k].found]) == (want, found), text
        kinds.update(f[0] for f in found)
        assert got[k]["_cuts"] == "own"
    assert min(kinds[k] for k in pii.PATTERNS) > 5
    empty = pii.pseudonymised(df.limit(0), "k")
    assert empty.count() == 0 and empty.columns == df.columns


@pytest.mark.parametrize("radices", [[7], [3, 2], [5, 4, 3], [189 // 9, 11]])
def test_feistel_is_a_permutation(spark, radices):
    total = int(np.prod(radices))
    digits, left = [], F.col("id")
    for r in radices:
        digits.append(left % r)
        left = F.floor(left / r)
    arrays = F.array(*[d.cast("long") for d in digits]), F.array(*[F.lit(r).cast("long") for r in radices])
    got = {tuple(r["v"]) for r in spark.range(total).select(pii.feistel(*arrays, "x", "k").alias("v")).collect()}
    assert len(got) == total and all(0 <= v < r for row in got for v, r in zip(row, radices))


def test_dates_are_permuted_over_all_days(spark):
    days = spark.range(0, 146097, 1, 4).select(F.date_format(F.date_add(F.to_date(F.lit("1800-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")).limit(3000)
    got = days.select(pii.MADE["date"](F.col("d"), "k").alias("p"), "d")
    assert got.select("p").distinct().count() == 3000 and got.where("p IS NULL").count() == 0


def test_licences_and_inheritance(spark):
    mit, apache = licences.TEMPLATES[16][1], "Licensed under the Apache License, Version 2.0."
    rows = [
        ("1", "r/LICENSE", mit), ("2", "r/a/b/code.py", "x = 1\n" * 50), ("3", "r/a/LICENSE.txt", apache), ("4", "r/a/c/d/e.py", "y\n# Released under the MIT License.\n" + "z\n" * 50),
        ("5", "other/file", "plain"), ("6", None, apache), ("7", "r/x", None), ("8", "r/a/c/d/f", ""), ("9", "top", "no licence cue that is known: copyright " + "w " * 60), ("10", "r/q/z", f"{apache}\n{apache}"), ("11", "r/q/y", "text"),
    ]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "file string, path string, text string, score2 double")
    got = {r.file: (r.licence, r.how, r.from_dir) for r in licences.licensed(df).collect()}
    assert got == {
        "1": ("MIT", "file", None), "2": ("Apache-2.0", "inherited", "r/a"), "3": ("Apache-2.0", "file", None), "4": ("MIT", "header", None), "5": (None, None, None), "6": ("Apache-2.0", "file", None),
        "7": ("MIT", "inherited", "r"), "8": ("Apache-2.0", "inherited", "r/a"), "9": (None, None, None), "10": ("Apache-2.0", "file", None), "11": ("Apache-2.0", "inherited", "r/q"),
    }
    assert licences.licensed(df.limit(0)).count() == 0


def test_inheritance_against_a_walk_up_the_tree(spark):
    """Random trees: the nearest directory above with a file that speaks for it; rows that share a file are one file."""
    rng = np.random.default_rng(5)
    spoken = {"MIT": licences.TEMPLATES[16][1], "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    rows, names = [], list(spoken)
    for k in range(160):
        folder = "/".join(rng.choice(["a", "b", "c"], rng.integers(0, 5)))
        licence = names[rng.integers(3)] if rng.random() < 0.15 else None
        own = (f"f{k:03d}", f"{folder}/f{k:03d}".lstrip("/") if k % 23 else None, spoken[licence] if licence else f"plain text {k}")
        rows += [own] * (1 + (k % 9 == 0))
    rows += [("twice", "b/z", "plain"), ("twice", "a/y", spoken["MIT"])]
    df = spark.createDataFrame(rows, "file string, path string, text string").withColumn("dir", F.lit("own")).withColumn("licence", F.lit("x"))
    said = {}
    files_ = {}
    for f, path, text in rows:
        files_.setdefault(f, []).append((path, text))
    own = {f: next((n for n, t in spoken.items() if t in [x[1] for x in xs]), None) for f, xs in files_.items()}
    score = {r.file: r.score for r in licences.licensed(df).collect()}
    for f, xs in sorted(files_.items()):
        paths = sorted(p for p, _ in xs if p is not None)
        if own[f] and paths:
            at = paths[0].rpartition("/")[0]
            said[at] = min(said.get(at, (1, "", "")), (-score[f], paths[0], own[f]))

    def wanted(f, path):
        if own[f]:
            return own[f], "file", None
        at = path.rpartition("/")[0] if path is not None else None
        while at is not None:
            if at in said:
                return said[at][2], "inherited", at
            at = at.rpartition("/")[0] if at else None
        return None, None, None

    got = Counter((r.file, r.path, r.licence, r.how, r.from_dir) for r in licences.licensed(df.repartition(5)).collect())
    assert got == Counter((f, p, *wanted(f, p)) for f, p, _ in rows)
    assert len(said) > 8


def test_every_licence_line_has_its_licence(spark):
    """The four licence lines of the tables' documents, and others that are near each other."""
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Released under the BSD 2-Clause License.": "BSD-2-Clause",
        "Released under the BSD 3-Clause License.": "BSD-3-Clause", "Licensed under the Terms of Nobody.": None,
    }
    df = spark.createDataFrame([(str(k), None, f"text before\n{x}\nand after") for k, x in enumerate(lines)], "file string, path string, text string")
    got = {r.file: r.licence for r in licences.licensed(df).collect()}
    assert [got[str(k)] for k in range(len(lines))] == list(lines.values())


def test_wrapped_notices(spark):
    """Notices over many lines, in comments, in long files with other cue lines, and with prose on their line."""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    wrapped = {spdx: "\n".join(textwrap.wrap(licences.TEMPLATES[k][1], 70)) for k, spdx in ((1, "Apache-2.0"), (4, "BSD-3-Clause"), (13, "ISC"), (16, "MIT"), (19, "Unlicense"))} | {"MPL-2.0": mpl}
    code = "\n".join(f"x{k} = f{k}(y{k})" for k in range(200))
    noise = "\n".join(f"print copyright{k} of licence number q{k} and r{k} by s{k}" for k in range(60))
    prose = " ".join(f"Thon q{k} haheble erre." for k in range(30))
    rows, want = [], {}
    for spdx, text in wrapped.items():
        commented = "\n".join(f"# {x}" for x in text.split("\n"))
        for how, whole in {"plain": text, "code": f"{commented}\n{code}", "noise": f"{noise}\n{commented}\n{noise}", "late": f"{code}\n{text}\n{code}"}.items():
            rows.append((f"{spdx} {how}", None, whole))
            want[rows[-1][0]] = spdx
    for name, text, spdx in (("prose", f"x\nLicensed under CC BY-NC 4.0. {prose}", "CC-BY-NC-4.0"), ("short", f"{code}\n\n// Released under\n// the MIT License.\n{code}", "MIT"), ("none", f"{noise}\n{prose}", None)):
        rows.append((name, None, text))
        want[name] = spdx
    df = spark.createDataFrame(rows, "file string, path string, text string")
    assert {r.file: r.licence for r in licences.licensed(df).collect()} == want


def test_cosines_against_brute_force(spark):
    import math
    import re

    lines = ["Released under the MIT License.", "this work is licensed under the GNU General Public License", "Licensed: Apache, version 2.0 or zzz", "copyright nobody"]
    vectors, other = licences.template_vectors(spark)
    parts = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "file long, part int, passage string")
    got = {r.file: (r.licence, r.score) for r in licences.cosines(parts, vectors, other).collect()}
    words = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower()))
    df = Counter(w for _, t in licences.TEMPLATES for w in words(t))
    n = len(licences.TEMPLATES)
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1

    def cosine(a, b):
        x, y = ({w: c * idf(w) for w, c in words(t).items()} for t in (a, b))
        return round(sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), 9)

    for k, line in enumerate(lines):
        best = min((-cosine(line, t), spdx) for spdx, t in licences.TEMPLATES)
        if best[0]:
            assert got[k][0] == best[1] and got[k][1] == pytest.approx(-best[0], abs=1e-8)


def test_passages_without_a_cue_word_of_old_keep_their_licence(spark):
    lines = {
        "CC BY-NC 4.0": "CC-BY-NC-4.0", "This work: Creative Commons Attribution-ShareAlike 4.0 International, under a deed": "CC-BY-SA-4.0",
        "Text: Creative Commons Attribution-NonCommercial 4.0 International": "CC-BY-NC-4.0", "free and unencumbered software": "Unlicense", "GNU General Public v3, version 3": "GPL-3.0", "some software of the public, version 3": None,
    }
    df = spark.createDataFrame([(str(k), None, f"text before\n\n{x}\n\nand after") for k, x in enumerate(lines)], "file string, path string, text string")
    assert {r.file: r.licence for r in licences.licensed(df).collect()} == {str(k): v for k, v in enumerate(lines.values())}


def test_the_cues_lose_no_passage(spark):
    """Random passages of template terms: none without a cue has the least cosine, and all that have it are found with the cues alone."""
    vectors, other = licences.template_vectors(spark)
    rows = [tuple(r) for r in vectors.select("template", "term", "weight").collect()]
    cues = licences.cue_terms(rows)
    every = sorted({t for _, t, _ in rows})
    assert all(licences.distinct(t) for t in cues)
    rng = np.random.default_rng(9)
    by = {}
    for k, t, _ in rows:
        by.setdefault(k, []).append(t)
    texts = []
    for k in range(400):
        own = by[k % len(by)]
        texts.append(" ".join([*rng.choice(own, rng.integers(1, min(len(own), 12) + 1)), *rng.choice(["q1z", "nothing", "der"], rng.integers(0, 3))]))
    texts += [" ".join(t for t in own if t not in cues) for own in by.values()]
    df = spark.createDataFrame([(str(k), None, t) for k, t in enumerate(texts)], "file string, path string, text string")
    found = [{(r.file, r.licence, r.score) for r in licences.cosines(licences.passages(licences.cued(df, some)), vectors, other).where(F.col("score") >= licences.LEAST).collect()} for some in (cues, every)]
    assert found[0] == found[1] and len(found[0]) > 50


def test_old_heads_of_responses():
    """Heads with bare line ends and fields without a blank keep their payload; what is no number names no page."""
    fields, head, payload = archive.http_parts(b"HTTP/1.0 200 OK\nContent-Length:5\nX-Page-Id: abc\n\n<html>\r\n\r\nx")
    assert fields == {"content-length": "5", "x-page-id": "abc"} and payload == b"<html>\r\n\r\nx" and head.endswith(b"abc\n\n")
    assert archive.http_parts(b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nmore")[1:] == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"body\n\nmore")
    assert archive.http_parts(b"HTTP/1.0 204 No\nA: b")[2] == b""
