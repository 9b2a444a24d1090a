"""Language-model scores of whole texts.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; each text ends with one end token (the empty word
here), so a null or empty text has that one token.

1. Words of all training texts are counted by a distributed aggregation; nothing is left out.
2. The most frequent words, at most `HEAD` of them, come to the driver: a bounded table.
3. The gated recurrent network (`gru`) knows the first of these as words and every other word by
   one of `REST` classes (of its last two bytes); in a class a word has its smoothed unigram
   probability (count + 1) / (all counts + distinct words + 1), the one left over being for words
   never seen. So P(text) is a proper product over all tokens, over an open vocabulary.
4. It is trained by truncated BPTT: a warm start on the driver from a bounded sample of about
   `WARM_DOCS` texts of `WARM_LONGEST` tokens at most, then one pass in parallel over all training texts. The state runs over whole
   texts and every window updates. Tasks' parameters are averaged by tokens.
5. Every text is scored with the state carried across windows. Words outside the head are returned
   by text and joined to the counts; the head is in memory, so no frequent word is ever a join key.

Texts of any length run whole, their state going from window to window; a task holds some megabytes of text at
a time. Tasks learn from the rows that the scan gives them, so another layout of the input's files
gives slightly other parameters and scores; the same layout gives the same. Only doc_id and text are read, so other
columns do no harm. Rows that repeat are scored alike. A null doc_id is scored too, and is in training if the caller's
condition says so. With no training text all counts are 0. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, own_texts, staged, table
from .gru import Gru, Lanes, Shape, flat, initial, unflat

HEAD = 1 << 18
WORDS, WORD_CLASSES, REST = 1024, 32, 32
TIES = 1024
#: Texts of the warm start, about, and the longest of them in tokens.
WARM_DOCS, WARM_LONGEST = 1200, 1 << 14
LANES, SCORE_LANES = 256, 512
LOG10 = float(np.log(10))


def rest_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % REST


@functools.cache
def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    """`rest_class` of the words of one byte and of two."""
    return np.array([rest_class(bytes([k])) for k in range(1 << 8)]), np.array([rest_class(bytes([k >> 8, k & 255])) for k in range(1 << 16)])


def rest_classes(words: pa.Array) -> np.ndarray:
    """`rest_class` of each word of an array of large binaries without nulls."""
    if not len(words):
        return np.zeros(0, np.int64)
    one, two = _class_tables()
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    sizes, ends = np.diff(ends), ends[1:]
    letters = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    last, before = letters[np.maximum(ends - 1, 0)].astype(np.int64), letters[np.maximum(ends - 2, 0)].astype(np.int64)
    return np.where(sizes > 1, two[before << 8 | last], np.where(sizes == 1, one[last], rest_class(b"")))


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each token's place among them, tokens by text); the end token is word 0."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(own_texts(texts)))
    flat_words = cut.flatten().dictionary_encode()
    distinct = pa.concat_arrays([pa.array([""], pa.large_string()), flat_words.dictionary])
    which = flat_words.indices.to_numpy().astype(np.int64) + 1
    bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    real = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)[which]
    kept = np.concatenate([[0], np.cumsum(real)])[bounds]
    return distinct, np.insert(which[real], kept[1:], 0), np.diff(kept) + 1


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (word binary, rest int, c long) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                distinct, which, _ = coded_words(part.column(1))
                n = np.bincount(which, minlength=len(distinct))
                some = np.flatnonzero(n)
                words = distinct.take(pa.array(some)).cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(rest_classes(words).astype(np.int32)), pa.array(n[some], pa.int64())], names=["word", "rest", "c"])
            give_back()

    return docs.mapInArrow(run, "word binary, rest int, c long").groupBy("word", "rest").agg(F.sum("c").alias("c"))


class Head:
    """The bounded table of frequent words, by falling count; what a task needs to code texts."""

    def __init__(self, words: list[bytes], counts: list[int], shape: Shape):
        self.words, self.shape = pa.array(words, pa.large_binary()), shape
        self.counts = np.array(counts, np.int64)

    def ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(model ids, place in the head or -1) of distinct words."""
        return self._ids(distinct.cast(pa.large_binary()), self.words)

    def model_ids(self, distinct: pa.Array) -> np.ndarray:
        """Model ids alone: words beyond the network's are told from it by a look in its few words."""
        return self._ids(distinct.cast(pa.large_binary()), self.words[: self.shape.words])[0]

    def _ids(self, words: pa.Array, among: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        place = pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where((place < 0) | (place >= self.shape.words), self.shape.words + rest_classes(words), place), place


def read_head(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The words of the highest counts, as many as `most` allows, and the end token.

    Of words tied at the last count, those come first whose hash is less; they are cut at one of TIES bounds.
    """
    cut, total = None, 0
    for row in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        total += row["count"]
        cut = row["c"]
        if total > most:
            total -= row["count"]
            break
    else:
        cut = 0
    place, bound = F.pmod(F.xxhash64("word"), F.lit(TIES)), 0
    if cut:
        for row in counts.where(F.col("c") == cut).groupBy(place.alias("place")).count().orderBy("place").collect():
            total += row["count"]
            if total > most:
                break
            bound = row["place"] + 1
    found = {} if cut is None else {bytes(r["word"]): r["c"] for r in counts.where((F.col("c") > cut) | ((F.col("c") == cut) & (place < bound))).select("word", "c").toLocalIterator()}
    if b"" not in found:
        found[b""] = next((r["c"] for r in counts.where(F.length("word") == 0).select("c").collect()), 0)
    order = sorted(found, key=lambda w: (-found[w], w))
    return order, [found[w] for w in order]


def _lanes(head: Head, texts: pa.Array, lanes: int) -> Lanes:
    distinct, which, sizes = coded_words(texts)
    return Lanes(head.model_ids(distinct)[which], sizes, head.shape, lanes)


def warm_start(docs: DataFrame, head: Head, params: dict, n_docs: int) -> tuple[dict, dict]:
    """Some passes on the driver over a bounded sample's ids: parameters and Adagrad's memory."""
    parts = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct, which, sizes = coded_words(batch.column(1))
            ids, ends = head.model_ids(distinct)[which].astype(np.int32), np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())], names=["doc_id", "ids"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < -(-WARM_DOCS * parts // max(1, n_docs))).limit(2 * WARM_DOCS)
    rows = sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in chosen.mapInArrow(run, "doc_id long, ids binary").where(F.length("ids") <= 4 * WARM_LONGEST).toLocalIterator())
    memory = {k: np.full_like(v, 1e-5) for k, v in params.items()}
    if not rows:
        return params, memory
    texts = [np.frombuffer(x, np.int32) for _, x in rows]
    model = Gru(head.shape, params)
    for rate in (0.1, 0.1, 0.05):
        memory = model.train(Lanes(np.concatenate(texts), np.array([len(x) for x in texts]), head.shape, 32), rate, memory=memory)
    return model.p, memory


def trained(docs: DataFrame, head: Head, params: dict, start: dict) -> dict:
    """One parallel pass over docs from `params`; the tasks' parameters, averaged by tokens.

    Every task goes on with the warm start's Adagrad memory `start`, so tasks stay near each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory, n = Gru(head.shape, dict(params)), {k: v.copy() for k, v in start.items()}, 0
        for batch in batches:
            for part in slices(batch):
                lanes = _lanes(head, part.column(1), LANES)
                n += int(lanes.sizes.sum())
                memory = model.train(lanes, 0.05, memory=memory)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [(flat(model.p).astype(np.float64) * n).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, sums = n + k, np.frombuffer(x) if sums is None else sums + np.frombuffer(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [sums.tobytes()]})

    schema = "n long, sums binary"
    parts = staged(docs.mapInArrow(run, schema), "lm-parts")
    n_parts = parts.count()
    if not n_parts:
        return params
    # A tree: each task adds about the root of the parts' number.
    some = parts.repartition(max(1, round(n_parts**0.5))).mapInArrow(add, schema)
    n, sums = next(iter(_pairs(some.repartition(1).mapInArrow(add, schema))))
    return unflat(np.frombuffer(sums) / n, params)


def _pairs(df: DataFrame) -> list[tuple[int, bytes]]:
    return [(r["n"], bytes(r["sums"])) for r in df.collect()]


def scored(docs: DataFrame, head: Head, params: dict, n_all: int, n_distinct: int, rest_counts: np.ndarray, rest_distinct: np.ndarray) -> DataFrame:
    """One row a text: what the head and the network tell, and the words outside the head."""
    rest_log = np.log10(rest_counts + rest_distinct + 1.0)
    base_log = float(np.log10(n_all + n_distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = Gru(head.shape, params), (TaskContext.get().partitionId() << 36)
        log_counts = np.log10(np.append(head.counts, 0) + 1.0)
        in_model = head.shape.words
        for batch in batches:
            for part in slices(batch):
                distinct, which, sizes = coded_words(part.column(1))
                ids, place = head.ids(distinct)
                starts = np.cumsum(sizes) - sizes
                own = log_counts[place][which]
                likelihood = model.score(Lanes(ids[which], sizes, head.shape, SCORE_LANES)) / LOG10
                is_rest = ids >= in_model
                rest_part = np.where(is_rest, log_counts[place] - rest_log[np.where(is_rest, ids - in_model, 0)], 0.0)[which]
                known = ((place >= 0) & (np.append(head.counts, 0)[place] > 0))[which]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                outside = np.flatnonzero((place < 0)[which])
                pair, n = np.unique(doc[outside] * len(distinct) + which[outside], return_counts=True)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(pair, np.arange(len(sizes) + 1) * len(distinct)), pa.int32()),
                    pa.StructArray.from_arrays([distinct.take(pa.array(pair % len(distinct))).cast(pa.large_binary()).cast(pa.binary()), pa.array(n, pa.int32())], ["word", "n"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(sizes))), part.column(0), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(own, starts) - base_log * sizes), pa.array(likelihood + np.add.reduceat(rest_part, starts)), lists,
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "base", "model", "outside"],
                )
                row += len(sizes)
            give_back()

    return docs.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, model double, outside array<struct<word:binary,n:int>>")


def lm_scores(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    learn = docs.where(training).select("doc_id", "text")
    counts = staged(word_counts(learn), "lm-counts")
    by_rest = counts.groupBy("rest").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    rest_counts, rest_distinct = np.zeros(REST), np.zeros(REST)
    for r in by_rest:
        rest_counts[r["rest"]], rest_distinct[r["rest"]] = r["c"], r["v"]
    n_all, n_distinct = int(rest_counts.sum()), int(rest_distinct.sum())
    words, c = read_head(counts, HEAD)
    known = min(WORDS, len(words))
    head = Head(words, c, Shape(known, min(WORD_CLASSES, known), REST))
    for w, n in zip(words[:known], c, strict=False):
        rest_counts[rest_class(w)] -= n
        rest_distinct[rest_class(w)] -= n > 0
    params = initial(head.shape, np.concatenate([np.array(c[:known], np.float64), rest_counts]))
    n_docs = next((n for w, n in zip(words, c, strict=True) if w == b""), 0)
    params = trained(learn, head, *warm_start(learn, head, params, n_docs))
    rows = staged(scored(docs.select("doc_id", "text"), head, params, n_all, n_distinct, rest_counts, rest_distinct), "lm-scored")
    outside = rows.select("row", F.explode("outside").alias("o")).select("row", "o.*").join(counts.select("word", "c"), "word")
    found = outside.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("outside").join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return lm_scores(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_scores": op1_lm_scores}
SQL: dict[str, str] = {}
