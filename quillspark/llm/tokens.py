"""Token ids as Huffman-coded files.

`tokenized` encodes whole texts; `write_files` puts ids in ascending doc_id order into files of
independent blocks, coded by one canonical length-limited Huffman code from the global counts;
`read_files` decodes them by table.

File format (integers little-endian): `QHUF1\\n`; uint32 and that many bytes of zlib-compressed
code lengths, one byte an id; blocks of up to `BLOCK` ids, each starting on a byte; a footer; its
length as uint64. The footer is an Arrow stream of two record batches' worth of columns: documents
(doc_id, n) in order, and blocks (first byte, n, checkpoints: the block's bit for every
huffman.STEP ids). A document's ids run on over blocks. The files' order and the number of ids
before each are in the manifest that `write_files` returns.

Data passes: tokenize and count (texts are read once; ids are staged, coded by a provisional code
from a bounded sample, which only affects the staged size), one range shuffle by doc_id, write, read.

A null text is empty and has only the end id. Documents with one id twice keep all rows, next to
each other; a null doc_id comes first. An empty table gives no files and no rows.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import arrow_rows, fresh_dir, give_back, own_texts, staged, table
from .huffman import LIMIT, STEP, Code, code_lengths

BLOCK = 1 << 16
#: Ids in a file, about: files stay near 20 MB and a task near 1 s of work a million ids.
IDS_PER_FILE = 1 << 23
#: Rows whose ids make the provisional code, at most about.
SAMPLE_ROWS = 200
MAGIC = b"QHUF1\n"
END_ID = 0
CODED_AT_ONCE = 1 << 18
#: Texts and bytes of texts that a task holds at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 5000, 8_000_000

#: Punctuation that often ends a word.
ENDINGS = ".,;:!?"

_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """The tokenizers library behind a bounded memory of pieces.

    The byte-level pattern never joins across a single space or line end between two other
    characters, except that it takes the space along to the right. So a text cut before each such
    space or line end encodes as its pieces do, and each distinct piece goes to the library once
    until the memory is emptied. Texts with other white space at a cut, or with a special token's
    string, go to the library whole.
    """

    def __init__(self, path: str, most: int = 300_000, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.end = most, self.kind.type(end_id).tobytes()
        #: Texts and their codes, last asked first.
        self.known: dict[str, tuple[pa.Array, pa.Array]] = {}
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for x, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if x.startswith(space)]] = True

    def _coded(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded_words(self, words: list[str]) -> list[bytes]:
        """As `_coded`, for spaces with letters after them: many go as one text.

        Each such word is split off by itself, and only its first token begins with a space.
        """
        groups = [words[k : k + 100] for k in range(0, len(words), 100)]
        ids = np.concatenate([np.zeros(0, np.int64), *[x.ids for x in self.tokenizer.encode_batch_fast(["".join(x) for x in groups], add_special_tokens=False)]]).astype(self.kind)
        starts = (np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * self.kind.itemsize).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def _coded_mixed(self, texts: list[str]) -> list[bytes]:
        spaced = [x[0] == " " for x in texts]
        words = iter(self._coded_words([x for x, s in zip(texts, spaced, strict=True) if s]))
        rest = iter(self._coded([x for x, s in zip(texts, spaced, strict=True) if not s]))
        return [next(words) if s else next(rest) for s in spaced]

    def _recall(self, texts: pa.Array, kind: str, code) -> pa.Array:
        """Codes of distinct texts. The `most` texts that were asked for last are kept, in Arrow arrays."""
        known, codes = self.known.get(kind, (pa.array([], texts.type), pa.array([], pa.large_binary())))
        at = pc.index_in(texts, value_set=known)
        missing = pc.is_null(at)
        new = pa.array(code(texts.filter(missing).to_pylist()), pa.large_binary())
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = len(codes) + np.arange(len(new))
        out = pa.concat_arrays([codes, new]).take(pa.array(place))
        rest = np.flatnonzero(~pc.is_in(known, value_set=texts).to_numpy(zero_copy_only=False))[: max(0, self.most - len(texts))]
        self.known[kind] = tuple(pa.concat_arrays([a, b.take(pa.array(rest))]) for a, b in ((texts, known), (out, codes)))
        return out

    def _pieces(self, pieces: pa.Array, lead: str) -> list[bytes | None]:
        """Codes of distinct pieces; None for those that are not safe to encode alone.

        Letters and the punctuation after them are never in one token, so a word is coded
        once for all its endings.
        """
        core = pc.utf8_rtrim(pieces, ENDINGS)
        worded = pc.utf8_is_alpha(pc.utf8_ltrim(core, "\n"))
        out = np.empty(len(pieces), object)
        if len(words := pieces.filter(worded)):
            cores, tails = core.filter(worded).dictionary_encode(), _tails(words, core.filter(worded)).dictionary_encode()
            kinds = [(cores, "first", self._coded)]
            if lead:
                cores = pa.DictionaryArray.from_arrays(cores.indices, pc.if_else(pc.starts_with(cores.dictionary, "\n"), cores.dictionary, pc.binary_join_element_wise(pa.scalar(lead, pieces.type), cores.dictionary, pa.scalar("", pieces.type))))
                kinds = [(cores, "inner", self._coded_mixed)]
            kinds.append((tails, "tails", self._coded))
            parts = [self._recall(x.dictionary, kind, code).take(x.indices) for x, kind, code in kinds]
            out[worded.to_numpy(zero_copy_only=False)] = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary())).to_pylist()
        rest = np.flatnonzero(~worded.to_numpy(zero_copy_only=False))
        plain = [x for x in pieces.take(pa.array(rest)).to_pylist()]
        safe = [bool(x) and not x[-1].isspace() and not (x[1:2] if x[0] == "\n" else x[0]).isspace() and not any(s in x for s in self.special) for x in plain]
        coded = iter(self._coded([x if x[0] == "\n" else lead + x for x, ok in zip(plain, safe, strict=True) if ok]))
        for k, ok in zip(rest, safe, strict=True):
            out[k] = next(coded) if ok else None
        return list(out)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by the end id, and their numbers by text.

        Cutting, telling pieces apart and putting ids together are Arrow's; Python sees each
        distinct piece of the batch once.
        """
        texts = own_texts(texts)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes = self._pieces(coded.dictionary, " ")
        which = coded.indices.to_numpy().astype(np.int64)
        starts = bounds[:-1]
        first = self._pieces(cut.flatten().take(pa.array(starts)), "")
        bad = np.array([x is None for x in codes], bool)[which]
        bad[starts] = [x is None for x in first]
        whole = np.flatnonzero(np.logical_or.reduceat(bad, starts)) if len(starts) else []
        n = len(codes)
        which[starts] = n + np.arange(len(first))
        codes += first
        for k, ids in zip(whole, self._coded([texts[int(k)].as_py() for k in whole]), strict=True):
            which[bounds[k] : bounds[k + 1]] = len(codes) + 1  # nothing
            which[bounds[k]] = n + k
            codes[n + k] = ids
        codes += [self.end, b""]
        which = np.insert(which, bounds[1:], len(codes) - 2)
        joined = pa.array(codes, pa.large_binary()).take(pa.array(which))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[bounds + np.arange(len(bounds))] // self.kind.itemsize
        return np.frombuffer(joined.buffers()[2], self.kind)[: ends[-1]], np.diff(ends)


def _tails(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What follows the core of each word: mostly nothing or one sign."""
    left = pc.subtract(pc.binary_length(words), pc.binary_length(cores))
    out = pc.if_else(pc.equal(left, 0), pa.scalar("", words.type), pc.utf8_slice_codeunits(words, -1))
    if (more := pc.greater(left, 1)).true_count:
        out = pc.if_else(more, pc.replace_substring_regex(words, r"^\n?\pL+", ""), out)
    return out


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _slices(texts: pa.Array, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts with about `most` bytes, one text at least."""
    for start, stop in _runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), most):
        yield start, texts.slice(start, stop - start)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs with about `most` in sum, one at least."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("marks", pa.binary()), ("counts", pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))])
TOKENS_DDL = "doc_id long, n long, ids binary, marks binary, counts array<struct<id:int,n:long>>"


def tokenized(docs: DataFrame, path: str, lengths: np.ndarray) -> DataFrame:
    """(doc_id, text) -> coded ids by document, and a row of counts for each task (n = -1).

    Counts meet the counted rows in one task's output, so a retried task counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other tasks of this worker have left
        encoder, code = _encoder(path), Code(lengths)
        counts = np.zeros(len(lengths), np.int64)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                all_ids, all_n = encoder(texts)
                counts += np.bincount(all_ids, minlength=len(counts))
                at = 0
                # The codec works on wide integers, so it gets some documents at a time.
                for first_doc, last_doc in _runs(all_n, CODED_AT_ONCE):
                    n = all_n[first_doc:last_doc]
                    ids = all_ids[at : at + n.sum()].astype(np.int64)
                    at += len(ids)
                    data, first, marks = code.encode(ids, n)
                    bounds = np.concatenate([[0], np.cumsum((n + STEP - 1) // STEP)]) * 4
                    raw = marks.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start + first_doc, len(n)), pa.array(n), pa.array([data[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.nulls(len(n), TOKENS.field("counts").type)], schema=TOKENS
                    )
                pa.default_memory_pool().release_unused()
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_pylist([{"doc_id": None, "n": -1, "ids": b"", "marks": b"", "counts": [{"id": int(i), "n": int(counts[i])} for i in used]}], schema=TOKENS)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS_DDL)


def sample_lengths(docs: DataFrame, path: str) -> np.ndarray:
    """A provisional code from up to SAMPLE_ROWS rows; every id of the vocabulary has a code."""
    encoder = PieceEncoder(path)
    counts = np.ones(encoder.size, np.int64)
    for row in docs.select("text").limit(SAMPLE_ROWS).toLocalIterator():
        counts += np.bincount(encoder(pa.array([row["text"]], pa.string()))[0], minlength=len(counts))
    return code_lengths(counts)


def global_lengths(coded: DataFrame, size: int, limit: int = LIMIT) -> np.ndarray:
    """The code from all documents' ids. The driver gets a row for each id of the vocabulary."""
    counts = np.zeros(size, np.int64)
    for row in coded.where("n = -1").select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    return code_lengths(counts, limit)


class FileWriter:
    """Writes one file; ids come in document order, any number at a time."""

    def __init__(self, out, code: Code):
        self.out, self.code, self.at = out, code, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.docs: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.blocks: list[tuple[int, int, bytes]] = []
        packed = zlib.compress(code.lengths.tobytes(), 9)
        self._put(MAGIC + struct.pack("<I", len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.lengths.append(lengths)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 8 * BLOCK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.int64)
        units = [min(BLOCK, n - k) for k in range(0, n, BLOCK)]
        data, first, marks = self.code.encode(ids[:n], np.array(units, np.int64))
        raw, k = marks.tobytes(), 0
        for a, size in zip(first, units, strict=False):
            own = (size + STEP - 1) // STEP * 4
            self.blocks.append((self.at + int(a), size, raw[k : k + own]))
            k += own
        self._put(data)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        docs = pa.table({"doc_id": pa.chunked_array(self.docs, pa.int64()), "n": np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)})
        blocks = pa.table({"at": pa.array([x[0] for x in self.blocks], pa.int64()), "n": pa.array([x[1] for x in self.blocks], pa.int64()), "marks": pa.array([x[2] for x in self.blocks], pa.binary())})
        for one in (docs, blocks):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(one)
            body = sink.getvalue()
            self._put(body + struct.pack("<Q", len(body)))


class FileReader:
    """Reads one file; `documents` yields each document's ids in runs, never the whole file."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of coded ids")
        (n,) = struct.unpack("<I", file.read(4))
        self.code = Code(np.frombuffer(zlib.decompress(file.read(n)), np.uint8))
        parts = []
        for _ in range(2):
            (n,) = struct.unpack("<Q", file.read_at(8, end - 8))
            parts.append(pa.ipc.open_stream(file.read_at(n, end - 8 - n)).read_all())
            end -= 8 + n
        self.blocks, self.docs = parts
        self.end = end

    def ids(self, block: int, count: int = 1) -> np.ndarray:
        """The ids of `count` blocks from `block` on; any block can be read by itself."""
        part = self.blocks.slice(block, count)
        at = part["at"].to_numpy()
        stop = self.blocks["at"][block + count].as_py() if block + count < len(self.blocks) else self.end
        data = self.file.read_at(stop - at[0], at[0])
        return self.code.decode(data, at - at[0], part["n"].to_numpy(), np.frombuffer(b"".join(part["marks"].to_pylist()), "<u4"))

    def runs(self, count: int = 16) -> Iterator[np.ndarray]:
        for k in range(0, len(self.blocks), count):
            yield self.ids(k, count)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, n, crc32 of the ids as little-endian uint32) in the file's order."""
        runs, data, at = self.runs(), b"", 0
        for doc_id, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n"].to_pylist(), strict=True):
            left, crc = 4 * n, 0
            while left:
                if at == len(data):
                    data, at = next(runs).astype("<u4").tobytes(), 0
                piece = data[at : at + left]
                crc = zlib.crc32(piece, crc)
                at += len(piece)
                left -= len(piece)
            yield doc_id, n, crc


MANIFEST_DDL = "file string, first_doc long, first_n long, first_key long, n_docs long, n_ids long"


def write_files(coded: DataFrame, provisional: np.ndarray, lengths: np.ndarray, folder: str, n_ids: int) -> DataFrame:
    """Write coded rows as files in doc_id order; returns the manifest (file, n_docs, n_ids, start).

    Documents that share an id, or have none, go by their number of ids and a hash of these, so they too are dealt to
    as many files as they fill.
    """
    n_files = max(1, -(-n_ids // IDS_PER_FILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        before, name, n_docs, total = Code(provisional), files.task_name("ids", "qhuf"), 0, 0
        with files.writing(folder, name) as out:
            writer, batch = FileWriter(out, Code(lengths)), first
            while batch is not None:
                for k in range(0, batch.num_rows, 500):
                    part = batch.slice(k, 500)
                    n = part.column(1).to_numpy()
                    data = part.column(2).to_pylist()
                    size = np.array([len(x) for x in data], np.int64)
                    ids = before.decode(b"".join(data), np.cumsum(size) - size, n, np.frombuffer(b"".join(part.column(3).to_pylist()), "<u4"))
                    writer.add(part.column(0), n, ids)
                    n_docs, total = n_docs + len(n), total + int(n.sum())
                give_back()
                batch = next(batches, None)
            writer.close()
        give_back()
        at = [first.column(c)[0].as_py() for c in (0, 1, 4)]
        yield pa.RecordBatch.from_pylist([{"file": name, "first_doc": at[0], "first_n": at[1], "first_key": at[2], "n_docs": n_docs, "n_ids": total}], schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("first_doc", "first_n", "first_key", "n_docs", "n_ids"))]))

    order = [F.col("doc_id").asc_nulls_first(), F.col("n").asc(), F.col("key").asc()]
    ranged = coded.where("n >= 0").select("doc_id", "n", "ids", "marks", F.xxhash64("ids").alias("key")).repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    manifest = staged(ranged.mapInArrow(run, MANIFEST_DDL), "ids-manifest")
    from pyspark.sql import Window

    # One row a file.
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_n", "first_key").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_files(manifest: DataFrame, folder: str, n_files: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.reading(folder, row["file"]) as file:
                    found = list(FileReader(file).documents())
                n = np.array([x[1] for x in found], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array(row["start"] + np.cumsum(n) - n), pa.array(n), pa.array([x[2] for x in found], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").repartition(max(1, n_files)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_files(docs: DataFrame, path: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """Tokenize docs (doc_id, text), write the files; returns (manifest, folder)."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "ids")
    provisional = sample_lengths(docs, path)
    with arrow_rows(spark, ROWS_AT_ONCE):
        coded = staged(tokenized(docs, path, provisional), "ids-coded")
    n_ids = coded.where("n >= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return write_files(coded, provisional, global_lengths(coded, len(provisional)), folder, n_ids), folder


def op9_token_files(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    manifest, folder = token_files(table(spark, sf_dir, "documents") if docs is None else docs, default_tokenizer())
    return read_files(manifest, folder, manifest.count())


QUERIES = {"op9_token_files": op9_token_files}
SQL: dict[str, str] = {}
