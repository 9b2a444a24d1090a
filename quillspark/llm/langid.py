"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter's largest answer in a
window goes through ReLU, and a softmax gives a probability for each language. Texts are cut into
fixed windows of `WINDOW` bytes that cover all of the text (the last one is padded with zeros); a
text's probabilities are its windows' means, weighted by their bytes.

Training takes windows spread over a bounded sample of labelled texts: about `DOCS_PER_LANG`
texts a language, chosen by a hash of doc_id, `WINDOWS_PER_DOC` windows each; the driver gets
these and no more. Prediction is one pass over the texts with no shuffle. Embedding and filters
fold into tables by byte pairs, so a filter's answer is one or two look-ups.

A null text, or one without a letter, is `und` with score 0; so is every text if nothing is
labelled. Of languages with equal probabilities the first by name wins. Rows that repeat are judged alike; lang,
source and doc_id are never inputs. Extra columns pass through; those named as the two results are replaced. An empty
table gives no rows. The sample takes DOCS_PER_LANG texts of each language, fewer if that is more than MOST_DOCS in all, so it has a bound
however many there are, and every language is learned; where ids repeat or are missing, texts tell rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, own_texts, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
DOCS_PER_LANG, MOST_DOCS = 400, 25_600
WINDOWS_PER_DOC = 6
STEPS = 700
BATCH = 96


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def windows_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes from each start on, padded with zeros after its size."""
    step = np.arange(WINDOW)
    at = starts[:, None] + step[None, :]
    return np.where(step[None, :] < sizes[:, None], data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8) if len(data) else np.zeros((len(starts), WINDOW), np.uint8)


class ByteCnn:
    """Parameters, training and prediction. `labels` are the learned languages in order."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        normal = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.params = {"embed": normal(256, EMBED, by=0.5), "out": normal(len(WIDTHS) * FILTERS, len(labels), by=0.2), "out_b": np.zeros(len(labels), np.float32)}
        for w in WIDTHS:
            self.params[f"conv{w}"] = normal(w * EMBED, FILTERS, by=(w * EMBED) ** -0.5)
            self.params[f"conv{w}_b"] = np.zeros(FILTERS, np.float32)
        self.params["embed"][0] = 0

    def fit(self, windows: np.ndarray, classes: np.ndarray, steps: int = STEPS, rate: float = 4e-3, seed: int = 8) -> None:
        """Adam on batches balanced over classes; half of the windows are cut short at random."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(classes == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(x) for k, x in self.params.items()}
        for step in range(1, steps + 1):
            want = rng.integers(0, len(by_class), BATCH)
            x = windows[[rng.choice(by_class[k]) for k in want]].copy()
            short = rng.random(BATCH) < 0.5
            size = np.where(short, rng.integers(6, WINDOW, BATCH), WINDOW)
            x[np.arange(WINDOW)[None, :] >= size[:, None]] = 0
            grads = self._gradients(x, want)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                self.params[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            self.params["embed"][0] = 0

    def _gradients(self, x: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(x)
        e = p["embed"][x]
        pooled, places = [], []
        for w in WIDTHS:
            length = WINDOW - w + 1
            z = sum(e[:, j : j + length] @ p[f"conv{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)) + p[f"conv{w}_b"]
            places.append(z.argmax(1))
            pooled.append(np.take_along_axis(z, places[-1][:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1)
        h = np.maximum(raw, 0)
        d = softmax(h @ p["out"] + p["out_b"])
        d[np.arange(n), want] -= 1
        d /= n
        grads = {"out": h.T @ d + 1e-4 * p["out"], "out_b": d.sum(0)}
        dh = (d @ p["out"].T) * (raw > 0)
        de = np.zeros_like(p["embed"])
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            own = dh[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"conv{w}_b"] = own.sum(0)
            filt = p[f"conv{w}"]
            g = np.empty_like(filt)
            for j in range(w):
                byte = x[rows, places[k] + j]
                g[j * EMBED : (j + 1) * EMBED] = np.einsum("nf,nfe->ef", own, p["embed"][byte])
                np.add.at(de, byte, own[:, :, None] * filt[j * EMBED : (j + 1) * EMBED].T[None])
            grads[f"conv{w}"] = g
        grads["embed"] = de
        return grads

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
        """For each width: its table by the first two bytes, and by the rest of its bytes."""
        out = []
        for w in WIDTHS:
            one = [self.params["embed"] @ self.params[f"conv{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            head = (one[0][:, None] + one[1][None, :] + self.params[f"conv{w}_b"]).reshape(65536, FILTERS)
            rest = None if w == 2 else one[2] if w == 3 else (one[2][:, None] + one[3][None, :]).reshape(65536, FILTERS)
            out.append((w, head, rest))
        return out

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for w, head, rest in tables:
            length = WINDOW - w + 1
            z = head.take(pair[:, :length], axis=0)
            if rest is not None:
                z += rest.take((x if w == 3 else pair)[:, 2 : 2 + length], axis=0)
            pooled.append(z.max(1))
        return softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.params["out"] + self.params["out_b"])

    def predict(self, texts: pa.Array, tables: list, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(class or -1, score) of each text."""
        texts = own_texts(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        size = np.diff(bounds)
        n = np.maximum(1, -(-size // WINDOW))
        doc = np.repeat(np.arange(len(texts)), n)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        starts, left = bounds[doc] + place, np.minimum(size[doc] - place, WINDOW)
        total = np.zeros((len(texts), len(self.labels)))
        for k in range(0, len(doc), at_once):
            part = slice(k, k + at_once)
            p = self.probabilities(windows_of(data, starts[part], left[part]), tables)
            np.add.at(total, doc[part], p * left[part, None])
        total /= np.maximum(size, 1)[:, None]
        letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        best = total.argmax(1)
        return np.where(letters, best, -1), np.where(letters, np.minimum(total[np.arange(len(best)), best], 1.0), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_windows(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id") -> list:
    """Rows (lang, doc_id, windows) of the bounded sample; the rest of each text stays where it is."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return []
    parts = 1 << 20
    each = max(1, min(DOCS_PER_LANG, MOST_DOCS // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(-each * parts // n))])
    # Ids may repeat or be missing, and texts may: whatever is chosen together, the limit holds.
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < share[F.col("lang")]).limit(2 * MOST_DOCS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                body = text.encode()
                last = max(0, len(body) - WINDOW)
                spots = sorted({round(last * k / (WINDOWS_PER_DOC - 1)) for k in range(WINDOWS_PER_DOC)}) if last else [0]
                rows.append({"lang": lang, "doc_id": doc_id, "windows": [body[k : k + WINDOW].ljust(WINDOW, b"\0") for k in spots] if any(c.isalpha() for c in text) else []})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("windows", pa.list_(pa.binary()))]))

    return chosen.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, "lang string, doc_id long, windows array<binary>").collect()


def train(docs: DataFrame, **names: str) -> ByteCnn | None:
    """The network from the labelled rows of docs; None if there are none."""
    rows = sorted((r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, bytes(x)) for r in training_windows(docs, **names) for x in r["windows"])
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    model = ByteCnn(labels)
    if len(labels) > 1:
        model.fit(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW), np.array([labels.index(r[0]) for r in rows]))
    return model


def identified(docs: DataFrame, model: ByteCnn | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with the language and its score in columns of these names; columns that had them go."""
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumn(names[0], F.lit("und")).withColumn(names[1], F.lit(0.0))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, labels = model.tables(), pa.array([*model.labels, "und"])
        for batch in batches:
            best, score = model.predict(batch.column(at), tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, labels.take(pa.array(np.where(best < 0, len(labels) - 1, best))), pa.array(score)], names=schema.names)
            give_back()

    return docs.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs.where(~held_out))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
