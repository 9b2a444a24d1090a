"""Merged decompositions against one of all vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def expected(vectors, most=4):
    """(n, sums, eigenvalues, vectors, trace) of the distinct whole vectors, by one eigendecomposition."""
    x = np.array(sorted({tuple(math.floor(256 * c) for c in v) for v in vectors}), np.float64)
    centred = x - x.mean(axis=0)
    values, found = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)
    return len(x), x.sum(axis=0), values[order][:most], found[:, order].T[:most], values.sum()


def run(spark, rows, tmp_path, schema=SCHEMA, parts=7):
    path = str(tmp_path)
    spark.createDataFrame(rows, schema).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).repartition(parts).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return whitening.op12_whitening(spark, path).collect()


def test_equal_to_one_decomposition_of_all(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 3
    vectors = [*base.tolist(), *base[:50].tolist(), *[base[0].tolist()] * 900]
    bad = [None, [1.0] * 11 + [None], [NAN] * 12, [1.0] * 11 + [INF], [1.0, 2.0], []]
    rows = [(k if k % 10 else None, v, k % 3) for k, v in enumerate(vectors)] + [(-1, v, 0) for v in bad]
    got = run(spark, rows, tmp_path)
    n, sums, values, found, trace = expected(vectors)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        if r.vec_id is not None:
            by.setdefault(r.vec_id, {})[r.component] = r
    sign = {}
    for k, v, _ in rows[: len(vectors)]:
        if k is None:
            continue
        x = np.array([math.floor(256 * c) for c in v])
        for c in range(4):
            r = by[k][c + 1]
            want = (x - sums / n) @ found[c] / np.sqrt(values[c])
            s = sign.setdefault(c, np.sign(want * r.whitened))
            assert abs(r.whitened - s * want) < 1e-6 and abs(r.explained / (values[c] / trace) - 1) < 1e-9
            assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, sums, strict=True))


def test_merging_loses_no_dimension():
    """Any tree of merges gives the singular values and vectors of the whole."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(400, 9)) * [300, 200, 100, 50, 20, 10, 5, 3, 2]).astype(np.int64) + 1000
    cuts = [0, 1, 2, 5, 90, 91, 300, 400]
    parts = [whitening.Summary.of(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    left = parts[0]
    for p in parts[1:]:
        left = left.merged(p)
    pairs = parts
    while len(pairs) > 1:
        pairs = [pairs[k].merged(pairs[k + 1]) if k + 1 < len(pairs) else pairs[k] for k in range(0, len(pairs), 2)]
    whole = whitening.Summary.of(x)
    for one in (left, pairs[0]):
        assert len(one.s) == 9 and list(one.sums) == list(whole.sums) and np.allclose(one.s, whole.s, rtol=1e-12)
        assert np.allclose(np.abs((one.v * whole.v).sum(axis=1)), 1, atol=1e-12)
        again = whitening.Summary.read(one.row(3))
        assert np.array_equal(again.v, one.v) and again.n == 400 and list(again.sums) == list(one.sums)


@pytest.mark.parametrize(
    ("rows", "whites"),
    [
        ([], []),
        ([(1, None, 0), (2, [], 0), (3, [], 0)], []),
        ([(1, [1.0, 2.0], 0)], [None, None]),
        ([(1, [1.0, 2.0], 0)] * 3, [None] * 6),
        ([(1, [0.5], 0), (2, [-0.5], 0)], [-1.0, 1.0]),
        ([(1, [-0.0], 0), (2, [0.0], 0), (3, [1.0], 0), (4, [1.0, 2.0], 0)], [-1.0, -1.0, 1.0]),
    ],
)
def test_small_and_flat_tables(spark, tmp_path, rows, whites):
    got = run(spark, rows, tmp_path, parts=2)
    assert sorted((r.whitened for r in got), key=lambda w: (w is not None, w)) == sorted(whites, key=lambda w: (w is not None, w))
    for r in got:
        assert (r.whitened is None) == (not r.explained)
        assert r.identity_error is None or r.identity_error < 1e-12


def test_flat_dimensions_and_huge_entries(spark, tmp_path):
    rows = [(k, [float(k), 7.0, -float(k), 1e300 if k == 3 else -1e18], 0) for k in range(20)]
    got = run(spark, rows, tmp_path)
    assert len(got) == 80 and {r.component for r in got if r.whitened is not None} == {1}
    assert all(r.deviation is None for r in got) and {r.n for r in got} == {20}
    flat = run(spark, [(k, [float(k), 7.0, -float(k)], 0) for k in range(20)], tmp_path)
    assert {r.component for r in flat if r.whitened is not None} == {1} and {round(r.explained, 12) for r in flat} == {0.0, 1.0}


def test_float_vectors_many_parts_and_reruns(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in rng.normal(size=5)], 0) for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = [sorted(run(spark, rows, tmp_path, SCHEMA.replace("double", "float"), 5)) for _ in range(2)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(runs[0]) == 1600 and np.allclose([r.whitened for r in runs[0]], [r.whitened for r in runs[1]], atol=1e-9)
