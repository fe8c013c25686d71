"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import Workspace

#: Rounds beyond which something is wrong: each pair of rounds shortens every path by about half.
ROUNDS = 64


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is tied to the least of u and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u, are tied to the least of those neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, work: Workspace, name: str = "component") -> DataFrame:
    """(u, v): v is the least node of u's component, for every node u of ``edges`` (u, v) that isn't the least itself.

    The edges are written to the shared folder after every round, so the lineage stays short and a
    lost executor costs one round. A node with very many neighbours is aggregated before the
    shuffle, and the joins are plain equi-joins, whose hot keys adaptive execution splits.
    """
    edges = work.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen = None
    for i in range(1, ROUNDS):
        edges = work.write(_small_star(_large_star(edges).where("u <> v").distinct()).distinct(), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges
        seen = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
