"""The Jaccard join against all pairs, and what its divisions promise."""

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common, jaccard
from quillspark.llm.components import components
from quillspark.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, region string"


def plain(rows, num=80, den=100):
    """(n_shingles by row, component by doc_id) by brute force."""
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            inter = len(sets[a] & sets[b])
            if a < b and inter and den * inter >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def corpus(seed, families=6, copies=14, extra=30):
    """Texts with shares of words changed around the threshold, chains, shared passages and odd cases."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(10**7)}"
    passage = " ".join(word() for _ in range(70))
    rows, i = [], 0
    for f in range(families):
        base = [word() for _ in range(int(rng.integers(3, 160)))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.integers(0, 1 + len(own) // 25 + (f % 3))):
                own[rng.integers(len(own))] = word()
            rows.append((i, " ".join(own), ""))
            i += 1
        base = base + [word() for _ in range(len(base) // 5)]
        rows.append((i, " ".join(base), ""))
        i += 1
    for _ in range(extra):
        rows.append((i, " ".join([*(word() for _ in range(rng.integers(1, 80))), passage]), ""))
        i += 1
    return rows + [(i, None, ""), (i + 1, "", ""), (i + 2, "a b", "x"), (i + 3, "A\tB", "y"), (i + 4, "a b c", ""), (i + 5, rows[0][1].upper(), ""), (i + 6, "long text of one word " + "x " * 30000, "")]


@pytest.mark.parametrize("seed", [0, 1])
def test_join_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)


def test_residue_in_many_blocks(spark, monkeypatch):
    """A family whose members are near the threshold, with blocks so small that it takes many."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.choice(120, rng.integers(1, 7), replace=False):
            own[k] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(own), ""))
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)
    assert 1 < len({g[2] for g in got}) < 90


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f", ""), (1, "a b c d e f", ""), (2, "a b c d e f", ""), (None, "a b c d e f", ""), (3, None, "")]
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3)], key=repr)
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_divisions_keep_every_link():
    """Any two linked sets share a region, whatever is frequent; sketches never rule a link out."""
    rng = np.random.default_rng(9)
    for n in [1, 2, 3, 4, 5, 8, 9, 15, 16, 30, 31, 32, 63, 64, 100, 128, 500, 1500] * 6:
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 5 + 1))
        room = n // 4 if not cut else max(0, int((n - cut) / 0.8) - n)
        y = np.concatenate([x[: n - cut], rng.integers(0, 2**63, rng.integers(0, room + 1)).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        inter = len(np.intersect1d(x, y))
        if not inter or 100 * inter < 80 * (len(x) + len(y) - inter):
            continue
        frequent = np.sort(rng.choice(x, len(x) * int(rng.integers(0, 11)) // 10, replace=False))
        assert len(np.intersect1d(jaccard.signatures(x, frequent), jaccard.signatures(y, frequent)))
        a, b = sorted((jaccard.sketch(x).view(np.uint64), jaccard.sketch(y).view(np.uint64)), key=len)
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        assert np.bitwise_count(a ^ b).sum() <= len(x) + len(y) - 2 * inter


def test_rarest_shingles_keep_every_link(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(40):
        x = rng.integers(0, 2**62, rng.integers(2, 90))
        y = np.concatenate([x[len(x) // 10 :], rng.integers(0, 2**62, len(x) // 12)])
        rows += [(2 * k, x.tolist()), (2 * k + 1, y.tolist())]
    got = {r["id"]: set(r["regions"]) for r in jaccard._by_rarest(spark.createDataFrame(rows, "id long, s array<long>"), 80, 100).collect()}
    linked = 0
    for k in range(40):
        x, y = set(rows[2 * k][1]), set(rows[2 * k + 1][1])
        if 100 * len(x & y) >= 80 * len(x | y):
            linked += 1
            assert got[2 * k] & got[2 * k + 1]
    assert linked > 20


def test_sets_of_sliced_columns():
    texts = pa.array(["one two three four five six", None, "É é A a", " x\x0by\x0cz ", "p q r s t p q r s t"] * 3)
    whole, part = shingle_sets(texts), shingle_sets(texts.slice(6, 5))
    assert [s.tolist() for s in part] == [s.tolist() for s in whole[6:11]]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_keep_every_link(spark, monkeypatch):
    """Tight groups fall into cells of their own; any two linked sets share a cell, or pivots do not part them."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(21)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 150).astype(np.uint64)
        for _ in range(10):
            own = base.copy()
            at = rng.choice(150, rng.integers(0, 14), replace=False)
            own[at] = rng.integers(0, 2**63, len(at))
            sets.append(np.unique(own))
    sketches = spark.createDataFrame([(k, len(s), jaccard.sketch(s).tolist()) for k, s in enumerate(sets)], "id long, n long, sketch array<long>")
    regions = spark.createDataFrame([(5, 7, k, True, k, len(sets)) for k in range(len(sets))], "region long, band int, id long, large boolean, component long, size long")
    cells, rest, pairs = jaccard.divided(regions, sketches, 0, 80, 100)
    held = {}
    for r in cells.collect():
        held.setdefault(r.id, set()).add(r.region)
    assert rest.count() == 0 and len({r for x in held.values() for r in x}) > 5
    assert sum(map(len, held.values())) <= 2 * len(sets)
    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                linked += 1
                assert held[a] & held[b]
    assert linked > 100 and all(p.a > p.b for p in pairs.collect())


def test_a_region_of_a_third_of_all_texts(spark):
    """Its rows know their pivot without a shuffle, and the result is that of all pairs."""
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: 58 - i % 3], f"t{i % 40}"]), "") for i in range(200)] + [(1000 + i, " ".join(f"o{rng.integers(10**6)}" for _ in range(40)), "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, jaccard.jaccard_components(docs).collect()))
    assert got == plain(rows)
    signed = jaccard.signed(docs, np.zeros(0, np.uint64), 5, 80, 100).withColumnRenamed("doc_id", "id")
    heavy, pivots = jaccard.heavy_regions(signed)
    assert len(heavy) and set(pivots) <= {r[0] for r in rows}


def test_staged_tables_go_when_the_join_is_done(spark, tmp_path, monkeypatch):
    from quillspark.llm import common

    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame(corpus(3, families=2, extra=5), SCHEMA)
    found = jaccard.jaccard_components(docs)
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["jaccard-components", "jaccard-rows"]
    assert sorted(map(tuple, found.collect())) == plain(corpus(3, families=2, extra=5))


def test_components_that_are_stars_take_no_round(spark):
    edges = [(10 * k + j, 10 * k) for k in range(5) for j in (1, 2, 3)]
    before = len(common._staged)
    got = components(spark.createDataFrame(edges + edges[:2], "a long, b long"))
    assert len(common._staged) == before + 1
    assert sorted(map(tuple, got.select("id", "component").collect())) == sorted(edges)
    # A vertex with two edges, and one that is an end and a start, are not settled.
    got = components(spark.createDataFrame([(3, 1), (3, 2), (5, 4), (6, 5)], "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {2: 1, 3: 1, 5: 4, 6: 4}
