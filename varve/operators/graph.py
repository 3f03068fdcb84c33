"""Governance graph: frontier search, tags, and projections from change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators.tiers import latest
from varve.session import shared_dir


def frontier(edges: DataFrame, start: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(node, hop): nodes first reached at each hop, start nodes at hop 0.

    Each hop joins the frontier with the edges and drops what has been
    visited; hops are written to the shared folder, so plans don't grow and a
    lost executor costs no earlier hop. `edges` has src and dst.
    """
    import uuid

    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/varve-frontier-{uuid.uuid4().hex}"
    a, b = ("dst", "src") if reverse else ("src", "dst")
    start.select("node", F.lit(0).alias("hop")).distinct().write.parquet(f"{folder}/0")
    for hop in range(1, depth + 1):
        visited = spark.read.parquet(*(f"{folder}/{k}" for k in range(hop)))
        last = spark.read.parquet(f"{folder}/{hop - 1}").select(F.col("node").alias(a))
        reached = edges.join(last, a).select(F.col(b).alias("node")).distinct().join(visited, "node", "left_anti")
        reached.select("node", F.lit(hop).alias("hop")).write.parquet(f"{folder}/{hop}")
        if spark.read.parquet(f"{folder}/{hop}").isEmpty():
            break
    return spark.read.parquet(*(f"{folder}/{k}" for k in range(hop + 1)) if depth else f"{folder}/0")


def hop_rows(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """How many edges leave the nodes of each hop, and to how many nodes."""
    out = edges.join(reached, edges["src"] == reached["node"])
    return out.groupBy("hop").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets"))


def apply_changes(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The state after ordered changes (op: upsert or delete): the last of each key, unless it deletes.

    A rename is a delete of the old key and an upsert of the new one.
    """
    return latest(events, [key], [seq]).where("op <> 'delete'").drop("op")


def members(pairs: DataFrame, by: str, of: str, name: str) -> DataFrame:
    """(by, n, name): the members of each side of a membership table, in order, joined by commas."""
    ordered = F.array_sort(F.collect_list(of)).cast("array<string>")
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias(name))


def both_sides(edges: DataFrame) -> DataFrame:
    """(node, other, side): each edge with its source and with its target, so either end finds it."""
    side = lambda a, b, s: F.struct(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(s).alias("side"))
    return edges.select(F.explode(F.array(side("src", "dst", "out"), side("dst", "src", "in"))).alias("e")).select("e.*")


def apply_tags(events: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(tags that hold, audit) of events (resource, tag, op: assign or remove): the last of each pair counts, the audit has all."""
    held = latest(events, ["resource", "tag"], [seq]).where("op = 'assign'").select("resource", "tag")
    return held, events.select("resource", "tag", "op", F.col(seq).alias("at"))


def renames(events: DataFrame, old: str, new: str) -> DataFrame:
    """Rename events as two changes each, the delete first."""
    change = F.explode(F.array(F.struct(F.col(old).alias("key"), F.lit("delete").alias("op")), F.struct(F.col(new).alias("key"), F.lit("upsert").alias("op"))))
    return events.select("*", change.alias("_c")).select("*", "_c.key", "_c.op").drop("_c", old, new)
