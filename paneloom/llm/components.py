"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneloom.session import materialise


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the least of a and its neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return pairs.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    linked = _with_least(down)
    return linked.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").union(
        linked.select("a", F.col("least").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and the smallest node of its component, for every node that has an edge (a, b)."""
    current = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        current = materialise(_small_star(_large_star(current)), "edges")
        row = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
