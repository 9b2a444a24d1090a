"""Exact Jaccard join of documents by word shingles, as a metric-space join with pivots.

Jaccard distance 1 - |x & y| / |x | y| is a metric, and so is the symmetric difference |x ^ y|, in which
linked sets of m and n shingles are within R = (1 - t) / (1 + t) * (m + n), so a set of n and any partner
within (1 - t) / t * n. A parity sketch maps sets to bits and never lengthens a distance, so what the
triangle inequality rules out between sketches it rules out between sets.

1. Equal sets are one vertex.
2. Unrelated texts are all at distance 1 from each other and from any document taken as a pivot, and no
   window parts them. The first division therefore takes its pivots in subspaces (`signatures`): rings of
   sizes around the empty set, a text near a ring's border being in both, and in a ring hashed parts of
   the shingles. Linked texts differ in R parts at most and meet in one of the first R + 1 at least. Parts
   that hold nothing but shingles frequent in a bounded sample are passed over where enough others are
   left; that changes costs, never results. The least vertex of a region is its pivot, and regions with
   one pivot are one region (`gathered`).
3. Each vertex has distances to the pivots of its regions; it is linked to the nearest one if exact
   Jaccard says so. Regions whose vertices are all connected are done.
4. Others are joined recursively (`divided`): `PIVOTS` of a region's vertices are pivots of Voronoi cells, a
   vertex goes to the cell of its nearest pivot, and to each other cell whose pivot is farther
   by 2R at most: if x and y are linked and y is in the cell of q, then d(x, q) <= d(y, q) + R <=
   d(y, p) + R <= d(x, p) + 2R for x's own pivot p. What is near no pivot is a cell of its own, its
   vertices replicated to the cells whose radius and R reach them. Cells are regions of the next round, until they have
   `BLOCK` vertices or fewer and list the pairs that sizes and sketches leave possible.
5. Where windows put most vertices into most cells (texts that share a passage and no more are all equally
   far from each other), pivots cannot part them. Such vertices are divided by their rarest shingles instead, and what
   is still large there meets block by block, two blocks a task.

Exact distances decide each pair that is listed. A region that holds very many vertices is never one key: the
heaviest regions of the first division never shuffle by region (`heavy_regions`), later ones are dealt
to `SALTS` or to blocks.

Rows with one doc_id are one document; where their texts differ, the set with the least fingerprint
is its set (n_shingles is each row's own; of equal fingerprints either will do, the sets are equal). A null
doc_id links with nothing and has no component. A text that is null or has no words has an empty set and is its own
component. Only the columns doc_id and text are read, and columns of other names do no harm; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, scratch, staged, staged_ids, table
from .components import components
from .shingles import fingerprint, mix, shingle_sets

NUM, DEN, WORDS = 80, 100, 5
#: Rows whose shingles tell which are frequent, at most about, and in how many of them.
SAMPLE_ROWS = 20_000
FREQUENT, MOST_FREQUENT = 3, 1 << 18
#: Regions of the first division that are dealt apart for their weight, at most (16 bytes each).
HEAVY = 1 << 16
#: Pivots of a round, vertices of a leaf or block, and of a leaf whose pairs meet by a plain join.
PIVOTS, BLOCK, FEW = 16, 256, 16
SALTS = 64


def band_of(n: int) -> int:
    return n.bit_length() - 1


def parts_of(band: int) -> int:
    """Parts for sets of 2 ** band shingles and more, below twice as many.

    Small sets get so many that two shingles seldom share one; larger ones get as few as leave
    R + 1 of them non-empty with room to spare.
    """
    return 1 << 16 if band < 5 else (7 << band) // 10 + 4


def banded(codes: np.ndarray, band: int) -> np.ndarray:
    """Regions with their band in the low bits; its vertices are of this band or the one below."""
    return (codes & ~np.uint64(63)) | np.uint64(band)


def signatures(s: np.ndarray, frequent: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The regions of a sorted set of hashes.

    Let need = R + 1. With `need` telling parts (those with a shingle that is not frequent) a set has
    the first `need` of these. Else it has all of its telling parts and its first `need` non-empty
    ones; with fewer than `need` non-empty parts it also joins the ring's region of such sets.
    Linked sets x and y agree in all parts but R; a part they agree in tells for both or for
    neither. Take the one whose last part comes first: if it has `need` telling parts, one agrees
    and the other set has it too, be it by number or because it has all. If neither set has, the
    same holds for non-empty parts, or both are in the ring's region.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    band, need = band_of(n), (den - num) * n // num + 1
    known = np.zeros(n, bool)
    if len(frequent):
        known = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    mixed, out = mix(s), []
    for b in (band, band + 1) if den * n // num >= 2 << band else (band,):
        part = ((s >> np.uint64(32)) * np.uint64(parts_of(b))) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        with np.errstate(over="ignore"):
            code = mix(np.add.reduceat(mixed, starts) + mix(part[starts] + np.uint64((b + 1) << 40)))
        telling = ~np.logical_and.reduceat(known, starts)
        full = np.flatnonzero(telling)
        if len(full) >= need:
            own = code[full[:need]]
        else:
            telling[:need] = True
            own = code[telling]
            if len(starts) < need:
                own = np.append(own, mix(np.array([b], np.uint64)))
        out.append(banded(own, b))
    return np.unique(np.concatenate(out)).view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their low bits, 2 ** (band + 3) of them and 256 at least.

    Each shingle that only one of two sets has flips one bit, so sketches differ in no more bits
    than the sets do in shingles, and with four bits a shingle or more unrelated sets are much farther
    from each other than linked ones. Half a sketch xor the other half is that of the next lower band.
    """
    size = max(256, 8 << band_of(len(s)))
    odd = (np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes that several different sets of a bounded sample share, sorted: the MOST_FREQUENT first of them.

    What a table of bounded size leaves out costs time and changes no result.
    """
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    parts = 1 << 20
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < -(-SAMPLE_ROWS * parts // total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), WORDS)
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s)[0] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["f", "s"])

    rows = chosen.select("doc_id", "text").mapInArrow(run, "f long, s array<long>").dropDuplicates(["f"]).select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(MOST_FREQUENT)
    return np.sort(np.array([r["s"] for r in rows.toLocalIterator()], np.int64).view(np.uint64))


def signed(docs: DataFrame, frequent: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, f1, f2, regions, sketch) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = shingle_sets(part.column(1), k)
                marks = [fingerprint(s) for s in sets]
                regions = pa.array([signatures(s, frequent, num, den) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), regions, pa.array([sketch(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "f1", "f2", "regions", "sketch"])
            give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, regions array<long>, sketch array<long>")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(id, s) by doc_id; where texts differ, the set with the least fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = shingle_sets(part.column(1), k)
                marks = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "f1", "f2", "s"])
            give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, f1 long, f2 long, s array<long>").where(F.size("s") > 0)
    return rows.groupBy("id").agg(F.min_by("s", F.struct("f1", "f2")).alias("s"))


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, inter, total) with the exact sizes of intersection and union."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", inter.alias("inter"), (F.size("sa") + F.size("sb")).cast("long").alias("sizes")).select("a", "b", "inter", (F.col("sizes") - F.col("inter")).alias("total"))


def jaccard_components(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id), one row for each row."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark) as keep:
        with scratch(spark) as keep_sets:
            docs_reps, reps = _vertices(docs, keep_sets, k, num, den)
        docs_reps = keep(docs_reps, "jaccard-rows")
        found = keep(components(_links(docs, reps, k, num, den)), "jaccard-components")
    named = docs_reps.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _vertices(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of every row, and (id, n, regions, sketch) of each distinct set, by its least document."""
    all_signed = staged(signed(docs, frequent_shingles(docs), k, num, den), "jaccard-signed")
    one = all_signed.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("f"))
    one = staged_ids(one.select("doc_id", "f.*"), "jaccard-one")
    rep_of = staged_ids(one.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "jaccard-represented")
    lists = all_signed.where("n > 0").groupBy("f1", "f2").agg(F.first(F.struct("n", "regions", "sketch")).alias("x"))
    reps = keep(rep_of.drop("size").join(lists, ["f1", "f2"]).select(F.col("rep").alias("id"), "x.*"), "jaccard-sets")
    rows = all_signed.select("doc_id", "n").join(_represented(one, rep_of), "doc_id", "left")
    return keep(rows, "jaccard-docs"), reps


def _represented(one: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, f1, f2) and (f1, f2, rep, size) -> (doc_id, rep): the least of the documents with equal sets.

    A set of very many documents is in its table SALTS times, and its documents are dealt to these.
    """
    many = _salted(sets.where(F.col("size") > BLOCK).select("f1", "f2", "rep"))
    met = one.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(many, ["f1", "f2", "_salt"], "left")
    few = met.where("rep IS NULL").select("doc_id", "f1", "f2").join(sets.where(F.col("size") <= BLOCK).select("f1", "f2", "rep"), ["f1", "f2"])
    return few.select("doc_id", "rep").unionByName(met.where("rep IS NOT NULL").select("doc_id", "rep"))


def heavy_regions(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(region, pivot) of the regions that hold much of all vertices, by region.

    A region with a hundredth of the vertices has its share of nearly every batch, and batches count
    theirs. Only the HEAVY heaviest come to the driver, so what is left has a bounded part of all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, ids = _exploded(batch)
            codes, first, n = np.unique(region, return_index=True, return_counts=True)
            some = n >= max(4, batch.num_rows // 64)
            yield pa.RecordBatch.from_arrays([pa.array(codes[some]), pa.array(ids[first[some]]), pa.array(n[some])], names=["region", "pivot", "n"])
        give_back()

    found = rows.select("id", "regions").mapInArrow(run, "region long, pivot long, n long").groupBy("region").agg(F.sum("n").alias("n"), F.min("pivot").alias("pivot"))
    kept = sorted((r["region"], r["pivot"]) for r in found.orderBy(F.desc("n"), "region").limit(HEAVY).toLocalIterator())
    return np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept], np.int64)


def _exploded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(region, id) of (id, regions)."""
    lists = batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)


def _gathered_batch(pivot: np.ndarray, band: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    rows = np.unique(np.stack([pivot, band, ids], 1)[pivot != ids], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2])], names=["pivot", "band", "id"])


def gathered(rows: DataFrame) -> DataFrame:
    """(id, regions) -> distinct (pivot, band, id) with pivot <> id.

    Regions are read in order from one shuffle; the first vertex of each is its pivot. The rows of
    heavy regions know theirs beforehand and stay where they are.
    """
    heavy, pivots = heavy_regions(rows)

    def is_heavy(region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(heavy, region), max(0, len(heavy) - 1))
        return (heavy[at] == region if len(heavy) else np.zeros(len(region), bool)), at

    def heavy_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, ids = _exploded(batch)
            there, at = is_heavy(region)
            yield _gathered_batch(pivots[at[there]], region[there] & 63, ids[there])
        give_back()

    def other_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, ids = _exploded(batch)
            there = ~is_heavy(region)[0]
            yield pa.RecordBatch.from_arrays([pa.array(region[there]), pa.array(ids[there])], names=["region", "id"])
        give_back()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, 0
        for batch in batches:
            region, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            if not len(region):
                continue
            fresh = np.append(last is None or region[0] != last, region[1:] != region[:-1])
            starts = np.maximum.accumulate(np.where(fresh, np.arange(len(region)), -1))
            own = np.where(starts < 0, pivot, ids[starts])
            yield _gathered_batch(own, region & 63, ids)
            last, pivot = region[-1], own[-1]
        give_back()

    rows, schema = rows.select("id", "regions"), "pivot long, band int, id long"
    dealt = rows.mapInArrow(other_rows, "region long, id long").repartition("region").sortWithinPartitions("region", "id").mapInArrow(runs, schema)
    return dealt.unionByName(rows.mapInArrow(heavy_rows, schema)).distinct() if len(heavy) else dealt.distinct()


def folded(sketch: str, band: str) -> Column:
    """Half a sketch xor the other half where it has the length of `band`, as the band below has half of it."""
    half = (F.size(sketch) / 2).cast("int")
    longs = F.greatest(F.call_function("shiftright", F.call_function("shiftleft", F.lit(4), F.col(band)), F.lit(6)), F.lit(4))
    return F.when(F.size(sketch) > longs, F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(sketch))


def apart(a: Column, b: Column) -> Column:
    """The bits in which two sketches of one length differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def least_apart(a: str, b: str, band: str) -> Column:
    """The bits in which two sketches differ, at their own length if it is one, else at that of the band below."""
    return F.when(F.size(a) == F.size(b), apart(F.col(a), F.col(b))).otherwise(apart(folded(a, band), folded(b, band)))


def possible(d: Column, n: str, m: str, num: int, den: int) -> Column:
    """Whether sizes and the distance of sketches leave a link possible."""
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (d * (den + num) <= (F.col(n) + F.col(m)) * (den - num))


def _region(pivot: str, band: str) -> Column:
    return F.xxhash64(pivot, band)


def _salted(regions: DataFrame) -> DataFrame:
    return regions.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SALTS)).cast("int")


def _flagged(members: DataFrame) -> DataFrame:
    """(region, band, id) with `large`: whether the region has more than BLOCK vertices."""
    sizes = members.groupBy("region").count().where(F.col("count") > BLOCK).select("region", F.lit(True).alias("_l"))
    rows = members.withColumn("_salt", _salt()).join(_salted(sizes), ["region", "_salt"], "left")
    return staged_ids(rows.select("region", "band", "id", F.coalesce("_l", F.lit(False)).alias("large")), "jaccard-members")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(region, band, id, large, component, size) of the regions with vertices of several components."""
    named = members.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = staged_ids(named.select("region", "band", "id", "large", "component"), "jaccard-named")
    stats = named.groupBy("region", "large").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    few = named.where("NOT large").join(stats.where("NOT large").select("region", "size"), "region")
    many = named.where("large").withColumn("_salt", _salt()).join(_salted(stats.where("large").select("region", "size")), ["region", "_salt"])
    return staged_ids(few.unionByName(many.select(*few.columns)), "jaccard-open")


def _nearest(star: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, band, id) -> pairs (a, b) of each vertex and its nearest pivot, where they may be linked."""
    side = lambda v, c: sketches.select(F.col("id").alias(v), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    # A pivot of very many vertices has its sketch SALTS times.
    many = _salted(star.groupBy("pivot").count().where(F.col("count") > BLOCK).select("pivot").join(side("pivot", "p"), "pivot"))
    met = star.withColumn("_salt", _salt()).join(many, ["pivot", "_salt"], "left").drop("_salt")
    met = met.where("n_p IS NOT NULL").unionByName(met.where("n_p IS NULL").drop("n_p", "s_p").join(side("pivot", "p"), "pivot").select(*met.columns))
    met = met.join(side("id", "x"), "id").withColumn("d", least_apart("s_x", "s_p", "band"))
    home = met.where(possible(F.col("d"), "n_x", "n_p", num, den)).groupBy("id").agg(F.min_by("pivot", F.struct("d", "pivot")).alias("p"))
    return home.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b"))


def divided(regions: DataFrame, sketches: DataFrame, turn: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large regions by Voronoi cells: (members of the cells, vertices that pivots cannot part, pairs with the nearest pivot).

    Pivots are PIVOTS vertices of a region, the least by a hash of each share. They go to the region's blocks,
    so a task has the vertices of a block and as many pivots. Vertices whose window has two cells at most go to
    these. Others, near no pivot, are the rest, a cell without a pivot; they also go to a cell if its
    pivot is farther by R at most than the cell's radius, as no partner of theirs lies outside it. A region
    counts as parted if its vertices are in two cells on average at most, and no cell has more than three quarters of
    them; so rounds end.
    """
    looks = sketches.select("id", "n", "sketch")
    share, order = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(PIVOTS)), F.xxhash64("id", F.lit(turn), F.lit(1))
    chosen = regions.groupBy("region", "band", "size", share.alias("_share")).agg(F.min_by("id", F.struct(order, "id")).alias("id"))
    pivots = chosen.join(looks, "id").select("region", "size", F.struct(F.col("id").alias("pivot"), F.col("n").alias("m"), folded("sketch", "band").alias("s")).alias("p"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    lists = pivots.groupBy("region", "size").agg(F.collect_list("p").alias("pivots")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("size")
    rows = regions.join(looks, "id").withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), blocks).cast("int"))
    met = rows.join(lists, ["region", "block"]).withColumn("sketch", folded("sketch", "band"))
    met = met.withColumn("far", F.transform("pivots", lambda p: F.struct(apart(F.col("sketch"), p["s"]).alias("d"), p["pivot"].alias("pivot"), p["m"].alias("m")))).withColumn("home", F.array_min("far"))
    reach = F.col("n") * (den - num) / num
    window = F.transform(F.filter("far", lambda x: x["d"] <= F.col("home.d") + 2 * reach), lambda x: x["pivot"])
    met = staged(met.select("region", "band", "id", "size", "n", "home", "far", window.alias("window")), "jaccard-distances")
    near = F.size("window") <= 2
    radii = met.where(near).groupBy("region", F.col("home.pivot").alias("pivot")).agg(F.max("home.d").alias("radius"))
    radii = radii.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "radius"))).alias("radii"))
    placed = met.withColumn("_salt", _salt()).join(_salted(radii), ["region", "_salt"], "left").drop("_salt")
    around = F.filter("far", lambda x: x["d"] <= F.element_at("radii", x["pivot"]) + reach)
    code = lambda p: F.xxhash64("region", p)
    cells = F.when(near, F.transform("window", code)).otherwise(F.concat(F.array(code(F.lit("rest"))), F.coalesce(F.transform(around, lambda x: code(x["pivot"])), F.array().cast("array<bigint>"))))
    placed = staged(placed.select("region", "band", "id", "size", cells.alias("cells")), "jaccard-cells")
    by_cell = placed.select("region", "size", F.explode("cells").alias("cell")).groupBy("region", "size", "cell").agg(F.count("*").alias("c"))
    stats = by_cell.groupBy("region", "size").agg(F.sum("c").alias("total"), F.max("c").alias("most"))
    verdicts = stats.select("region", ((F.col("total") <= 2 * F.col("size")) & (F.col("most") * 4 <= F.col("size") * 3)).alias("parted"))
    judged = placed.withColumn("_salt", _salt()).join(_salted(verdicts), ["region", "_salt"])
    cells = judged.where("parted").select(F.explode("cells").alias("region"), "band", "id")
    pairs = met.where(F.col("id") != F.col("home.pivot")).withColumn("m", F.col("home.m")).where(possible(F.col("home.d"), "n", "m", num, den))
    pairs = pairs.select(F.greatest("id", "home.pivot").alias("a"), F.least("id", "home.pivot").alias("b"))
    return cells, judged.where("NOT parted").select("id").distinct(), pairs


def _listed(regions: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of different components in a region that sizes and sketches leave possible.

    The pairs of regions with FEW vertices or fewer meet in a join. Others' vertices are dealt to blocks of about
    BLOCK, and each two blocks meet in a task of their own, which sees 2 * BLOCK sketches or so; only pairs that may
    be linked come out. One vertex of a task is its pivot: distances to it that differ by more than R rule
    pairs out by the triangle inequality.
    """
    rows = regions.join(sketches.select("id", "n", "sketch"), "id")
    few = rows.where(F.col("size") <= FEW)
    other = few.select("region", F.col("id").alias("id_"), F.col("component").alias("component_"), F.col("n").alias("n_"), F.col("sketch").alias("sketch_"))
    near = few.join(other, "region").where("id > id_ AND component <> component_").where(possible(least_apart("sketch", "sketch_", "band"), "n", "n_", num, den))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(9)), blocks).cast("int")
    dealt = rows.where(F.col("size") > FEW).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = dealt.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "n", "sketch", folded("sketch", "band").alias("short"))

    def meet(unit: pa.Table) -> pa.Table:
        n, ids, parts = (unit.column(c).to_numpy() for c in ("n", "id", "component"))
        x, whole = (unit.column(c).combine_chunks() for c in ("short", "sketch"))
        x = x.flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        longer = np.diff(whole.offsets.to_numpy()) > x.shape[1]
        whole, place = whole.filter(pa.array(longer)).flatten().to_numpy().view(np.uint64).reshape(-1, 2 * x.shape[1]), np.cumsum(longer) - 1
        to_pivot = np.bitwise_count(x ^ x[0]).sum(1, dtype=np.int64)
        a, b = [], []
        for k in range(len(n) - 1):
            m = np.arange(k + 1, len(n))
            most = (n[k] + n[m]) * (den - num)
            m = m[(parts[m] != parts[k]) & (np.minimum(n[m], n[k]) * den >= np.maximum(n[m], n[k]) * num) & (np.abs(to_pivot[m] - to_pivot[k]) * (den + num) <= most)]
            if len(m):
                far = np.bitwise_count(x[m] ^ x[k]).sum(1, dtype=np.int64)
                m = m[far * (den + num) <= (n[k] + n[m]) * (den - num)]
                if longer[k]:  # two long sketches say more
                    far = np.where(longer[m], np.bitwise_count(whole[place[m]] ^ whole[place[k]]).sum(1, dtype=np.int64), 0)
                    m = m[far * (den + num) <= (n[k] + n[m]) * (den - num)]
                a += np.maximum(ids[m], ids[k]).tolist()
                b += np.minimum(ids[m], ids[k]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    listed = units.groupBy("region", "i", "j").applyInArrow(meet, "a long, b long")
    return near.select(F.col("id").alias("a"), F.col("id_").alias("b")).unionByName(listed)


class _Known:
    """Pairs with their exact sizes; no pair is measured twice."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs, self.k, self.num, self.den, self.pairs = docs, k, num, den, None

    def measure(self, pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        fresh = staged_ids(pairs if self.pairs is None else pairs.join(self.pairs.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-pairs")
        if fresh.isEmpty():
            self.pairs = self.pairs if self.pairs is not None else fresh.withColumn("inter", F.lit(0).cast("long")).withColumn("total", F.lit(1).cast("long"))
            return
        sets = staged(self.sets(fresh.select("a").union(fresh.select("b")).distinct().toDF("id")), "jaccard-shingles")
        found = staged_ids(measured(fresh, sets), "jaccard-known")
        self.pairs = found if self.pairs is None else self.pairs.unionByName(found)

    def sets(self, ids: DataFrame) -> DataFrame:
        return sets_of(self.docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), self.k)

    def links(self) -> DataFrame:
        return self.pairs.where(F.col("inter") * self.den >= F.col("total") * self.num).select("a", "b")


def _links(docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) links that connect all that is linked."""
    sketches, known = reps.select("id", "n", "sketch"), _Known(docs, k, num, den)
    star = staged(gathered(reps), "jaccard-star")
    known.measure(_nearest(star, sketches, num, den))
    hard = _joined(_members(star), sketches, known, True)
    if hard is not None:
        # Regions are read three times, so they are made once.
        rarest = staged(_by_rarest(staged(known.sets(hard), "jaccard-shingles"), num, den), "jaccard-rarest")
        star = staged(gathered(rarest), "jaccard-star")
        _joined(_members(star), sketches, known, False)
    return known.links()


def _members(star: DataFrame) -> DataFrame:
    """(region, band, id) of the pivots' regions, pivots included."""
    both = star.select("pivot", "band", "id").unionByName(star.select("pivot", "band", F.col("pivot").alias("id")).distinct())
    return both.select(_region("pivot", "band").alias("region"), "band", "id")


def _joined(members: DataFrame, sketches: DataFrame, known: _Known, dividing: bool) -> DataFrame | None:
    """Measure all pairs in regions that may connect components; returns vertices (id) that pivots cannot part."""
    turn, hard, num, den = 0, None, known.num, known.den
    while True:
        flagged = _flagged(members)
        if flagged.isEmpty():
            return hard
        active = _open(flagged, known.links())
        if active.isEmpty():
            return hard
        pairs = _listed(active.where("NOT large") if dividing else active, sketches, num, den)
        large = active.where("large")
        if not dividing or large.isEmpty():
            known.measure(pairs)
            return hard
        members, rest, near = divided(large, sketches, turn, num, den)
        known.measure(pairs.unionByName(near))
        if not rest.isEmpty():
            hard = staged_ids(rest if hard is None else hard.union(rest).distinct(), "jaccard-hard")
        turn += 1


def ring(n: int) -> int:
    """Sizes that differ by 6 % at most share a ring."""
    return int(np.log(n) / np.log(1.06) + 1e-9)


def least_of(ring: int) -> int:
    """No set of the ring is smaller."""
    return max(1, int(np.ceil(1.06**ring * (1 - 1e-9))))


def _by_rarest(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, s) -> (id, regions): a region for a shingle and two rings of sizes.

    Sets of sizes m and n that are linked share o = t / (1 + t) * (m + n) shingles at least. In any
    common order, the first m - o + 1 of one and n - o + 1 of the other have one in common. Rare
    shingles come first, so texts that share a passage, or copies that were each changed in their own
    places, seldom meet. For each ring that a partner may be in, o is that of the ring's least size.
    """
    rows = sets.select("id", F.explode("s").alias("x"))
    counts = rows.groupBy("x").agg(F.count("*").alias("c"))
    ordered = rows.join(counts, "x").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda e: e["x"]).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                own, n = np.array(s, np.int64).view(np.uint64), len(s)
                here, keys = ring(n), []
                for other in range(ring(-(-n * num // den)) - 1, ring(n * den // num) + 2):
                    least = max(-(-n * num // den), least_of(other))
                    o = -(-num * (n + least) // (num + den))
                    if other >= 0 and n - o + 1 > 0:
                        with np.errstate(over="ignore"):
                            codes = mix(own[: n - o + 1] + mix(np.array([(min(here, other) << 20) | max(here, other)], np.uint64)))
                        keys.append(banded(codes, band_of(least_of(min(here, other))) + 1))
                out.append(np.unique(np.concatenate(keys)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "regions"])

    return ordered.select("id", "s").mapInArrow(run, "id long, regions array<long>")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 80 * (na.n + nb.n - inter)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM w
  UNION
  SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(root) FROM reach WHERE reach.id = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
SQL = {"op5_ngram_jaccard": OP5_SQL}
