"""Connected components over an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from varve.llm.common import written

#: A node is hot with more than a HOT-th of the edges, and more than LEAST_HOT.
HOT, LEAST_HOT = 500, 256


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst: long).

    component is the smallest node reachable. This is union-find as a dataflow
    (alternating large-star and small-star): each round hangs the neighbours
    of a node below the smallest of them, until nothing moves; the number of
    rounds grows with the logarithm of the longest path. Neighbourhoods are
    reduced to minima by partial aggregation, never gathered, and a node with
    more than a HOT-th of all edges (there are fewer than 2 * HOT of those)
    hands its minimum out by broadcast, so its edges don't meet in one task.
    Each round is a written table, so a lost executor costs one round at most.
    Nulls and loops are dropped; an empty edge table gives an empty result.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges, now = _counted(edges)
    for _ in range(max_rounds):
        before, most = now, max(LEAST_HOT, now[0] // HOT)
        edges, now = _counted(_small_star(_large_star(edges, most), most))
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    low = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(low)


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and a sum of hashes, taken while writing."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum")), "edges")
    return table, (seen.get["n"], seen.get["sum"])


def _beside_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """Edges with `low` of their src.

    A src with more than `most` edges joins by broadcast, so its edges stay
    where they are; with `most` a share of all edges there are few of those.
    """
    hot = least.where(F.col("edges") > most).select("src", "low")
    rest = least.where(F.col("edges") <= most).select("src", "low")
    return edges.join(F.broadcast(hot), "src").unionByName(edges.join(rest, "src"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Neighbours larger than a node go below the smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"), F.count("*").alias("edges"))
    moved = _beside_least(both.where("dst > src"), least, most).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.where("src <> dst").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """A node and its smaller neighbours go below the smallest of those."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("edges"))
    moved = _beside_least(edges, least, most).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()
