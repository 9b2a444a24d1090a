"""PCA whitening of embeddings by merging singular value decompositions.

An entry c becomes the whole number floor(256 * c), and the fit list has each distinct vector of these
once. Each task decomposes its part of the list batch by batch and keeps (n, mean, singular
values, right singular vectors), all of them: at most as many as dimensions, so nothing is
truncated. Two such summaries merge by stacking their scaled vectors and one more row,
sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), which holds what recentring changes, and decomposing
the stack again. `FAN_IN` summaries merge in a task, level by level, until one is left. Up to
rounding the result is the decomposition of the centred list, whatever the parts were; covariances are
never formed from uncentred products. Column sums are kept apart as whole numbers, exact.

Scale. The list is made distinct by one shuffle with partial aggregation and staged; a task holds a
batch and a summary of d * d doubles; a merge holds FAN_IN of them; the driver gets one. Rows are whitened where they
are read, with the leading vectors in the task's closure.

Results. A null vector, and one with a null, NaN or infinite entry, has no rows. Vectors have one dimension, that of
most rows (of equal numbers the larger); rows with another are left out like those with bad entries. An empty vector
has no components. 256 * c beyond 64 bits becomes the nearest 64-bit number. Repeated rows and ids get rows each.
Components whose eigenvalue is 0 up to rounding have null in `whitened` and 0 in `explained` (null if all
are); `identity_error` is over the others of those returned, null if there are none. A `deviation`
beyond 64 bits is null. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged, table

SCALE = 256
COMPONENTS = 4
#: Summaries that one merge takes.
FAN_IN = 4
#: Vector entries that a task works on at a time.
ENTRIES_AT_ONCE = 1 << 20

SUMMARY_DDL = "part long, n long, sums binary, mean binary, s binary, v binary"


def whole(vector: Column) -> Column:
    """The vector of floor(256 * c), null unless all entries are finite numbers."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def whole_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(ident, x) of the rows that count, and their dimension."""
    all_rows = rows.select(F.col(ident), whole(F.col(vector)).alias("x")).where("x IS NOT NULL")
    most = all_rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return all_rows.where(F.size("x") == d), d


@dataclass
class Summary:
    """n vectors: exact sums, mean, and the decomposition of the centred vectors with all dimensions."""

    n: int
    sums: np.ndarray  # of Python's whole numbers
    mean: np.ndarray
    s: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        big = x.astype(object) if len(x) and int(np.abs(x.astype(np.float64)).max()) * len(x) >= 1 << 62 else x
        sums = np.array([int(k) for k in big.sum(axis=0)], object)
        # The mean of whole numbers, to double precision.
        mean = np.array([k / len(x) for k in sums], np.float64)
        _, s, v = np.linalg.svd(x.astype(np.float64) - mean, full_matrices=False)
        return cls(len(x), sums, mean, s, v)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        correction = np.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        stack = np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, correction])
        _, s, v = np.linalg.svd(stack, full_matrices=False)
        d = len(self.mean)
        sums = self.sums + other.sums
        return Summary(n, sums, np.array([k / n for k in sums], np.float64), s[:d], v[:d])

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": " ".join(map(str, self.sums)).encode(), "mean": self.mean.tobytes(), "s": self.s.tobytes(), "v": self.v.tobytes()}

    @classmethod
    def read(cls, row) -> Summary:
        mean, s = np.frombuffer(row["mean"]), np.frombuffer(row["s"])
        sums = np.array([int(k) for k in bytes(row["sums"]).split()], object)
        return cls(int(row["n"]), sums, mean, s, np.frombuffer(row["v"]).reshape(len(s), len(mean)))

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues of the covariance (divisor n), falling, and their unit vectors as rows.

        A value that rounding alone can make is 0. The sign is the one with which the largest entry is positive.
        """
        least = max(self.n, len(self.mean)) * np.finfo(np.float64).eps * (self.s[0] if len(self.s) else 0.0)
        v = self.v * np.where(self.v[np.arange(len(self.s)), np.abs(self.v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None] if len(self.s) else self.v
        return np.where(self.s > least, self.s, 0.0) ** 2 / self.n, v


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), d)


def _slices(batch: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, ENTRIES_AT_ONCE // max(1, d))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def summaries(distinct: DataFrame, d: int) -> DataFrame:
    """A row for each task of `distinct` (x) that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in _slices(batch, d):
                one = Summary.of(_matrix(part.column(0), d))
                total = total.merged(one) if total else one
        if total:
            context = TaskContext.get()
            yield pa.RecordBatch.from_pylist([total.row(context.partitionId() if context else 0)], pa.schema([("part", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("sums", "mean", "s", "v"))]))

    return distinct.select("x").mapInArrow(run, SUMMARY_DDL)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """FAN_IN summaries of neighbouring parts, in their order, so that reruns add in one order."""
    rows = rows.sort_values("part")
    total = None
    for row in rows.to_dict("records"):
        one = Summary.read(row)
        total = total.merged(one) if total else one
    return pd.DataFrame([total.row(int(rows["part"].iloc[0]) // FAN_IN)])


def fit(distinct: DataFrame, d: int) -> Summary | None:
    """The summary of a list of vectors (x) of dimension d; None for an empty list or dimension."""
    if not d:
        return None
    level = staged(summaries(distinct, d), "svd-parts")
    top = level.agg(F.max("part")).first()[0]
    while top:
        level = level.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(_merge, SUMMARY_DDL)
        top //= FAN_IN
    row = level.first()
    return Summary.read(row) if row else None


class Whitening:
    """The leading components of a fit, as what tasks need to whiten rows of whole numbers."""

    def __init__(self, found: Summary, most: int = COMPONENTS):
        values, vectors = found.components()
        k = min(most, len(found.mean))
        pad = max(0, k - len(values))  # a list shorter than its dimension has no vectors for the rest
        self.n, self.sums, self.mean = found.n, found.sums, found.mean
        self.values = np.concatenate([values, np.zeros(pad)])[:k]
        self.vectors = np.vstack([vectors, np.zeros((pad, len(found.mean)))])[:k]
        total = values.sum()
        self.explained = [float(x / total) if total > 0 else None for x in self.values]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component, over its standard deviation; NaN where that is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, ((x.astype(np.float64) - self.mean) @ self.vectors.T) / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - sums) ** 2), exact; None beyond 64 bits."""
        largest = self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, map(int, self.sums)), default=0)
        if largest * largest * max(1, x.shape[1]) < 1 << 62:
            return ((self.n * x - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, self.sums, strict=True)) for row in x]
        return [k if k < 1 << 63 else None for k in found]


def identity_error(distinct: DataFrame, model: Whitening, d: int) -> float | None:
    """The largest absolute entry of cov(whitened) - identity over the list, by Spark's own centred covariances."""
    used = np.flatnonzero(model.values > 0)
    if not len(used):
        return None
    names = [f"w{k}" for k in range(len(used))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, d):
                scores = model.scores(_matrix(part.column(0), d))[:, used]
                yield pa.RecordBatch.from_arrays([pa.array(scores[:, k]) for k in range(len(used))], names=names)

    scores = distinct.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    entries = [F.abs(F.covar_pop(a, b) - float(a == b)) for i, a in enumerate(names) for b in names[: i + 1]]
    return scores.agg(F.greatest(*entries) if len(entries) > 1 else entries[0]).first()[0]


def whitened(rows: DataFrame, d: int, model: Whitening, error: float | None, ident_type: str) -> DataFrame:
    """(ident, x) -> a row for each component."""
    k = len(model.values)
    schema = f"vec_id {ident_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, d):
                x = _matrix(part.column(1), d)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                scores = model.scores(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each),
                        pa.array(scores, mask=np.isnan(scores)), pa.array(model.explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = whole_vectors(table(spark, sf_dir, "embeddings"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    with scratch(spark):
        distinct = staged(rows.select("x").distinct(), "distinct-vectors")
        found = fit(distinct, d)
        if found is None:
            return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
        model = Whitening(found)
        error = identity_error(distinct, model, d)
    return whitened(rows, d, model, error, kind)


QUERIES = {"op12_whitening": op12_whitening}
SQL: dict[str, str] = {}
