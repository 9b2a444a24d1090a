"""Connected components of a graph in tables, by alternating large and small stars.

Each round makes every vertex point at the least vertex it knows of; edges never grow in number
beyond vertices and edges given, so rounds shrink to a forest of stars in a logarithm of steps.
A vertex with very many edges is aggregated by partial minima and joined back by an equi-join
that adaptive execution splits; no vertex's edges meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged_ids


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) edges -> (id, component) for every vertex of an edge but the components' least ones."""
    now = staged_ids(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u")
        now = staged_ids(_star(large, "true", with_centre=True).distinct(), "stars")
    raise RuntimeError("components did not settle")


def _star(edges: DataFrame, which: str, with_centre: bool = False) -> DataFrame:
    """Neighbours v of each u (those that `which` says) point at the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = edges.where(which).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if with_centre:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count("*")).first()[0] == 0
