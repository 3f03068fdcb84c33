"""What the operators on vectors share: usable rows, one row an id, and a grid of shards and query blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.common import written

#: A shard has this many times the root of all rows, so shards and their size grow
#: alike, up to what a task holds; a block of queries has a fixed bound.
SHARD_ROOT, SHARD_MOST = 8, 1 << 16


def finite(vector: Column) -> Column:
    """True where neither the vector nor an entry is null, and every entry is a finite number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def length_of(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, entries of each vector); vectors of several lengths are an error, no rows have 0 entries."""
    found = df.agg(F.count("*").alias("n"), F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most")).first()
    if found.least != found.most:
        raise ValueError(f"{column}: vectors have {found.least} to {found.most} entries")
    return found.n, found.most or 0


def one_an_id(df: DataFrame, key: str, name: str) -> DataFrame:
    """A written table with one row for each id: of rows that share it the least one; null ids name no row.

    Copies of one id are reduced before the shuffle, so one id with a third of all rows is no large group.
    """
    rest = [c for c in df.columns if c != key]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return written(least.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)), name)


def shards_of(rows: int) -> int:
    return max(1, math.ceil(rows / min(SHARD_MOST, SHARD_ROOT * math.sqrt(rows)))) if rows else 1


def over_grid(rows: DataFrame, queries: DataFrame, key: str, query_key: str, count: int, query_count: int, most: int, task: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`task` on each cell of a grid: every shard of rows meets every block of at most about `most` queries once.

    Both are dealt by a hash of their id, so neither equal vectors nor a
    frequent label meet in one task. A cell holds one shard and one block.
    """
    shards, blocks = shards_of(count), max(1, -(-query_count // most))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")).withColumn("_block", every(blocks))
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # they come from the rows
    right = queries.withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), query_key), F.lit(blocks)).cast("int")).withColumn("_shard", every(shards))
    cell = ["_shard", "_block"]
    left, right = (df.repartition(shards * blocks, *cell).groupBy(*cell) for df in (left, right))
    return left.cogroup(right).applyInArrow(task, schema)


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Equally long lists as rows of a matrix."""
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(whole), -1) if len(whole) else flat.reshape(0, 0)
