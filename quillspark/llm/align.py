"""Alignment of two tokenizers over the bytes of a text.

For tokenizer A each byte has an owner, the token that it belongs to (token indices repeated by the
tokens' lengths), and so for B. Where both owners change at once the text can be cut: what
lies between two cuts is a group of A tokens and B tokens over the same bytes. Consecutive distinct
pairs of owners are the overlaps. The A token and the B token that end at a cut are a link.

A encodes a space and the text, B encodes the text and adds the space itself; neither adds special
tokens, and their strings inside texts are plain text. A text that is null or empty, or of which
the joined bytes of A's or B's tokens are not the space and the text, has no tokens and no links.

Texts are cut before single spaces and line ends between other characters, where neither tokenizer joins: A
by its pattern, B because no piece of its vocabulary has a space or line end after another sign (checked when it
is loaded; else texts are not cut). Each distinct piece of a batch is encoded and aligned once,
and a document's arrays are its pieces' in order. Texts with other white space at a cut, or with U+2581, are encoded whole.

Counts of linked id pairs are over all documents: each batch adds its own counts to the rows that it
writes, Spark sums them, and the table (id pair, links, whether that is the most for its B id) is cut into slices of `PAIRS_AT_ONCE`
pairs at most. A pass over the staged links adds what a slice holds; there are as many passes as
slices, so a worker's table is bounded at any size and no link is shuffled.

Rows that repeat an id are documents each; a null id stays null. A text of any length is one row. An
empty table gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, give_back, own_texts, staged, table
from .files import read_columns
from .tokens import _slices, default_tokenizer

#: Texts and bytes of texts that a task holds at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 5000, 8_000_000
#: Linked id pairs that a worker holds, 13 bytes each.
PAIRS_AT_ONCE = 4_000_000
SPACE_SIGN = "\u2581"

_aligners: dict[tuple[str, str], Aligner] = {}
#: The slice of the pair table that this worker used last.
_held: tuple[tuple[str, ...], tuple[np.ndarray, ...]] | None = None


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer: it encodes a list of texts, and each of its tokens has bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes], joins: bool = False):
        self.encode, self.tokens, self.joins = encode, pa.array(tokens, pa.large_binary()), joins
        self.lengths = np.array([len(x) for x in tokens], np.int64)


def byte_level(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    special = {i: x.content.encode() for i, x in tokenizer.get_added_tokens_decoder().items()}
    names = {i: x for x, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    tokens = [special[k] if k in special else bytes(alphabet[c] for c in names.get(k, "")) for k in range(max(names) + 1)]

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Side(encode, tokens)


def sentence_pieces(path: str) -> Side:
    """Texts begin with the space that the model would add, or with a line end where they go on with another text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    tokens = [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace(SPACE_SIGN, " ").encode() for k, x in enumerate(pieces)]
    joins = any(SPACE_SIGN in x.lstrip(SPACE_SIGN) or "\n" in x for x in pieces)

    def encode(texts: list[str]) -> list[list[int]]:
        """The model adds a space to each text; before a line end it is a token by itself, and goes."""
        found = model.encode([x if x[0] == "\n" else x[1:] for x in texts], num_threads=1)
        return [y[1:] if x[0] == "\n" else y for x, y in zip(texts, found, strict=True)]

    return Side(encode, tokens, joins)


def _runs_of(body: pa.Buffer | None, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The runs of a buffer that end there."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), body or pa.py_buffer(b"")])


class Units:
    """Texts that are aligned each by itself: numbers of tokens, links and overlaps, and the groups' and links' bytes."""

    def __init__(self, texts: list[str], aligner: Aligner):
        n, sides = len(texts), (aligner.a, aligner.b)
        data = [x.encode() for x in texts]
        sizes = np.array([len(x) for x in data], np.int64)
        sound, ids, counts = np.ones(n, bool), [], []
        for side in sides:
            found = side.encode(texts)
            counts.append(np.array([len(x) for x in found], np.int64))
            flat = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
            ids.append(flat)
            ends = np.concatenate([[0], np.cumsum(side.lengths[flat])])[np.cumsum(counts[-1])] if n else sizes
            joined = side.tokens.take(pa.array(flat)).buffers()[2]
            whole = memoryview(joined or b"").cast("B")
            starts = np.concatenate([[0], ends[:-1]]) if n else sizes
            sound &= ends - starts == sizes
            if whole != b"".join(data):
                for k in np.flatnonzero(sound):
                    sound[k] = whole[starts[k] : ends[k]] == data[k]
        self.sound = sound
        ids = [x[np.repeat(sound, m)] for x, m in zip(ids, counts, strict=True)]
        self.n_a, self.n_b = (m * sound for m in counts)
        owner_a, owner_b = (np.repeat(np.arange(len(x)), side.lengths[x]) for x, side in zip(ids, sides, strict=True))
        new_a, new_b = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (owner_a, owner_b))
        # Both owners change after the last byte of a unit, so no group or link joins two units.
        cut = np.flatnonzero(new_a & new_b)
        ends = np.cumsum(sizes * sound)
        self.n_links = np.diff(np.searchsorted(cut, np.concatenate([[0], ends])))
        self.n_overlaps = np.diff(np.searchsorted(np.flatnonzero(new_a | new_b), np.concatenate([[0], ends])))
        last_a, last_b = owner_a[cut], owner_b[cut]
        self.pairs = (ids[0][last_a] * len(aligner.b.tokens) + ids[1][last_b]).astype("<u4")
        self.links = _runs_of(pa.py_buffer(self.pairs.tobytes()), np.cumsum(self.n_links) * 4)
        # Groups as text: A's tokens of a group come before B's, each with the sign that follows it.
        chosen, order, base = [], [], 0
        for k, (flat, last, side) in enumerate(zip(ids, (last_a, last_b), sides, strict=True)):
            ending = np.zeros(len(flat), np.int64)
            ending[last] = 1
            order.append((np.cumsum(ending) - ending) * 2 + k)
            chosen.append(base + flat + ending * len(side.tokens))
            base += 2 * len(side.tokens)
        words = aligner.decimals.take(pa.array(np.concatenate(chosen)[np.argsort(np.concatenate(order), kind="stable")]))
        at = np.frombuffer(words.buffers()[1], np.int64) if len(words) else np.zeros(1, np.int64)
        self.groups = _runs_of(words.buffers()[2], at[np.cumsum(self.n_a + self.n_b)])


class Aligner:
    """Two tokenizers over the same texts; each distinct piece of a batch is aligned once."""

    def __init__(self, a: Side, b: Side):
        if len(a.tokens) * len(b.tokens) > 1 << 32:
            raise ValueError("pairs of ids take 32 bits")
        self.a, self.b = a, b
        marks = ((a, ",|"), (b, ",;"))
        self.decimals = pa.array([f"{k}{sign}" for side, signs in marks for sign in signs for k in range(len(side.tokens))], pa.large_binary())

    def _cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Units to align, and for each unit of each text its number and its text's."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        joins = self.a.joins or self.b.joins
        safe = np.array([not joins and bool(x) and not x[-1].isspace() and not (x[1:2] if x[0] == "\n" else x[0]).isspace() and SPACE_SIGN not in x for x in pieces], bool)
        units = [x if x[0] == "\n" else " " + x for x, ok in zip(pieces, safe, strict=True) if ok]
        which = coded.indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        whole = np.bincount(owner, ~safe[which], len(texts)) > 0 if len(texts) else np.zeros(0, bool)
        number, keep = (np.cumsum(safe) - 1)[which], ~whole[owner]
        alone = np.flatnonzero(whole & (pc.binary_length(texts).to_numpy() > 0))
        number[bounds[alone]] = len(units) + np.arange(len(alone))
        keep[bounds[alone]] = True
        return units + [" " + texts[int(k)].as_py() for k in alone], number[keep], owner[keep]

    def __call__(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], list[bytes], list[bytes], tuple[np.ndarray, np.ndarray]]:
        """Each text's numbers, groups and links, and all linked pairs with their numbers."""
        texts = own_texts(texts)
        n = len(texts)
        names, which, owner = self._cut(texts)
        units = Units(names, self)
        lost = np.bincount(owner, ~units.sound[which], n) > 0 if n else np.zeros(0, bool)
        which, owner = which[~lost[owner]], owner[~lost[owner]]
        numbers = {name: np.bincount(owner, getattr(units, name)[which], n).astype(np.int64) for name in ("n_a", "n_b", "n_links", "n_overlaps")}
        ends = np.cumsum(np.bincount(owner, minlength=n))
        found = []
        for column in (units.groups, units.links):
            joined = column.take(pa.array(which))
            at = np.frombuffer(joined.buffers()[1], np.int64) if len(which) else np.zeros(1, np.int64)
            body = memoryview(joined.buffers()[2] or b"")
            bounds = np.concatenate([[0], at[ends]])
            found.append([body[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        often = np.repeat(np.bincount(which, minlength=len(names)), units.n_links)
        pairs, inverse = np.unique(units.pairs[often > 0], return_inverse=True)
        return numbers, *found, (pairs, np.bincount(inverse, often[often > 0], len(pairs)).astype(np.int64))


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(byte_level(a_path), sentence_pieces(b_path))
    return _aligners[a_path, b_path]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
ALIGNED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in NUMBERS), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])
ALIGNED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, links binary, pairs binary, pair_counts binary"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, text) -> a row for each document, with its links, and rows of pair counts (n_a = -1).

    Counts stand in the output of the task whose rows they count, so a retried task counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            for start, texts in _slices(batch.column(1), BYTES_AT_ONCE):
                numbers, groups, links, (pairs, counts) = aligner(texts)
                m = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, m), *(pa.array(numbers["n_links" if c == "n_groups" else c]) for c in NUMBERS),
                        pa.array([hashlib.sha256(x[:-1]).hexdigest() if len(x) else "" for x in groups]), pa.array([pa.compress(x, "zstd", asbytes=True) if len(x) else b"" for x in links], pa.binary()),
                        pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                    ],
                    schema=ALIGNED,
                )
                if len(pairs):
                    row = dict.fromkeys(NUMBERS, -1) | {"doc_id": None, "groups_sha256": "", "links": b"", "pairs": pairs.astype("<u4").tobytes(), "pair_counts": counts.astype("<i8").tobytes()}
                    yield pa.RecordBatch.from_pylist([row], ALIGNED)
                del groups, links
                pa.default_memory_pool().release_unused()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED_DDL)


def pair_table(found: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many links each id pair is, and whether none with its B id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(*batch.to_pydict().values(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(pairs, "<u4").astype(np.int64)), pa.array(np.frombuffer(counts, "<i8"))], names=["pair", "n"])

    each = found.where("n_a = -1").select("pairs", "pair_counts").mapInArrow(run, "pair long, n long")
    sums = each.groupBy("pair").agg(F.sum("n").alias("n"))
    # A B id has as many rows as A has ids at most.
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % n_b)))


def _slice_of(paths: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    global _held
    if _held is None or _held[0] != paths:
        _held = None
        pair, n, best = (read_columns(paths, ["pair", "n", "best"])[c].to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        _held = paths, (pair[order].astype(np.uint32), n[order], best[order].astype(np.int64))
    return _held[1]


def _added(docs: DataFrame, paths: tuple[str, ...], last: bool) -> DataFrame:
    """docs with what the pairs in these files add to n_best and count_sum."""
    columns = [c for c in docs.columns if not (last and c == "links")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = _slice_of(paths)
        for batch in batches:
            links = batch.column("links")
            n_links = batch.column("n_links").to_numpy()
            sums = {c: batch.column(c).to_numpy().copy() for c in ("n_best", "count_sum")}
            for start, part in _slices(links, BYTES_AT_ONCE):
                m = n_links[start : start + len(part)]
                data = b"".join(pa.decompress(x.as_buffer(), int(k) * 4, "zstd", asbytes=True) for x, k in zip(part, m.tolist(), strict=True) if k)
                asked = np.frombuffer(data, "<u4")
                at = np.minimum(np.searchsorted(pair, asked), max(0, len(pair) - 1))
                hit = pair[at] == asked if len(pair) else np.zeros(len(asked), bool)
                ends = np.cumsum(m)
                for name, values in (("n_best", best), ("count_sum", n)):
                    total = np.concatenate([[0], np.cumsum(np.where(hit, values[at], 0) if len(pair) else hit)])
                    sums[name][start : start + len(part)] += total[ends] - total[ends - m]
            yield pa.RecordBatch.from_arrays([pa.array(sums[c]) if c in sums else batch.column(c) for c in columns], names=columns)
        give_back()

    return docs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in docs.select(*columns).dtypes))


def linked(docs: DataFrame, a_path: str, b_path: str, pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum."""
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS_AT_ONCE):
        found = staged(aligned(docs, a_path, b_path), "aligned")
    pairs = staged(pair_table(found, len(sentence_pieces(b_path).tokens)), "pairs")
    slices = max(1, -(-pairs.count() // pairs_at_once))
    rows = found.where("n_a >= 0").drop("pairs", "pair_counts").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(slices):
        own = pairs if slices == 1 else staged(pairs.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k), "pair-slice")
        rows = _added(rows, tuple(sorted(own.inputFiles())), k == slices - 1)
        if k < slices - 1:
            rows = staged(rows, "links-added")
    return rows


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), default_tokenizer(), piece_model())


QUERIES = {"op13_alignment": op13_alignment}
SQL: dict[str, str] = {}
