"""Nearest neighbours by largest inner product with a vantage-point tree for each shard.

With h = sqrt(M^2 - |x|^2), where M is the shard's largest norm, (x, h) lies on
a sphere, and so does a query scaled to norm M, with h = 0: the nearest point
there has the largest inner product, so the triangle inequality holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import ship
from varve.llm.vectors import finite, length_of, matrix, one_an_id, over_grid

LEAF = 64
#: Queries of a block at most, about, and cells of a task's score matrix.
QUERIES_A_BLOCK, CELLS = 1 << 16, 1 << 22
#: Gaps count this many times, so a side is left out that might hold a neighbour; 1 is exact.
FACTOR = 4.0
_SLACK = 1e-9


@dataclass
class _Node:
    start: int
    stop: int
    vantage: np.ndarray | None = None
    shells: tuple[tuple[float, float], tuple[float, float]] | None = None
    sides: tuple[int, int] | None = None


class VantageTree:
    """Rows of a shard; a leaf is a slice of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        squares = (x * x).sum(axis=1)
        self.radius = float(np.sqrt(squares.max()))
        points = np.c_[x, np.sqrt(np.maximum(self.radius**2 - squares, 0))]
        order, self.nodes, todo = np.arange(len(ids)), [_Node(0, len(ids))], [0]
        while todo:
            node = self.nodes[todo.pop()]
            size = node.stop - node.start
            if size <= leaf:
                continue
            here = order[node.start : node.stop]
            own = points[here]
            # the point furthest from the middle sees the others at the most different distances
            at = int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax())
            far = np.sqrt(((own - own[at]) ** 2).sum(axis=1))
            half = size // 2
            by = np.argpartition(far, half)
            order[node.start : node.stop], far = here[by], far[by]
            node.vantage = own[at]
            node.shells = ((far[:half].min(), far[:half].max()), (far[half:].min(), far[half:].max()))
            node.sides = (len(self.nodes), len(self.nodes) + 1)
            todo += node.sides
            self.nodes += [_Node(node.start, node.start + half), _Node(node.start + half, node.stop)]
        self.ids, self.x = ids[order], x[order]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, place, score) of the k nearest found by each query, ties included, and how many pairs were scored.

        A query doesn't find the row whose id is its own. A side of a node is
        left out where `factor` times the gap between the query and the shell
        of distances it holds is beyond the k-th nearest so far. Scores are
        sums in one order, so that equal vectors have equal scores.
        """
        found, scored = [], 0
        step = max(1, CELLS // len(self.ids))
        for at in range(0, len(queries), step):
            rows, places, seen = self._some(queries[at : at + step], own[at : at + step], k, factor)
            found.append((rows + at, places))
            scored += seen
        rows, places = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))
        return rows, places, (queries[rows] * self.x[places]).sum(axis=1), scored

    def _some(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        scaled = queries * (self.radius / np.sqrt((queries * queries).sum(axis=1)))[:, None]
        scores = np.full((len(queries), len(self.ids)), -np.inf)
        best = np.full((len(queries), k), -np.inf)
        home = np.full(len(queries), -1)
        square = self.radius**2

        def distance(node: _Node, who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2 * square - 2 * (scaled[who] @ node.vantage[:-1]), 0))

        def read(node: _Node, who: np.ndarray) -> int:
            got = scaled[who] @ self.x[node.start : node.stop].T
            got[self.ids[node.start : node.stop][None, :] == own[who][:, None]] = -np.inf
            scores[who, node.start : node.stop] = got
            best[who] = np.partition(np.c_[best[who], got], -k, axis=1)[:, -k:]
            return got.size

        # first the leaf where a query would stand itself, for a bound
        pairs, todo = 0, [(0, np.arange(len(queries)))]
        while todo:
            number, who = todo.pop()
            node = self.nodes[number]
            if node.sides is None:
                pairs += read(node, who)
                home[who] = number
                continue
            inner = distance(node, who) <= node.shells[0][1]
            todo += [(side, part) for side, part in zip(node.sides, (who[inner], who[~inner])) if len(part)]
        # then every side that isn't too far
        todo = [(0, np.arange(len(queries)))]
        while todo:
            number, who = todo.pop()
            node = self.nodes[number]
            if node.sides is None:
                if len(rest := who[home[who] != number]):
                    pairs += read(node, rest)
                continue
            from_vantage = distance(node, who)
            reach = np.sqrt(np.maximum(2 * square - 2 * best[who].min(axis=1), 0)) + _SLACK * self.radius
            for side, (low, high) in zip(node.sides, node.shells):
                near = factor * np.maximum(low - from_vantage, from_vantage - high) <= reach
                if near.any():
                    todo.append((side, who[near]))
        enough = np.maximum(best.min(axis=1) - _SLACK * square, -np.finfo(float).max)
        return *np.nonzero(scores >= enough[:, None]), pairs


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product that each query finds.

    `rows` and `queries`: (vec_id, vector), one row an id, no zero vectors. All
    rows are in trees, every query goes through every tree; factor 1 gives the
    exact result. Fewer than k candidates all appear. Ties go to the smaller id.
    """
    spark = rows.sparkSession
    ship(spark)
    (count, dims), asked = length_of(rows, "vector"), queries.count()
    schema = "query_id long, vec_id long, score double"
    if not count or not asked or not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        tree = VantageTree(left["vec_id"].to_numpy(), matrix(left["vector"], np.float64))
        names = right["vec_id"].to_numpy()
        who, places, scores, _ = tree.search(matrix(right["vector"], np.float64), names, k, factor)
        ids = tree.ids[places]
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        first = np.searchsorted(who, who)
        top = np.arange(len(who)) - first < k
        return pa.table([pa.array(names[who[top]]), pa.array(ids[top]), pa.array(scores[top])], names=["query_id", "vec_id", "score"])

    found = over_grid(rows, queries, "vec_id", "vec_id", count, asked, QUERIES_A_BLOCK, search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searchable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A written table (vec_id, vector), one row an id.

    Vectors that are null, zero or hold a null or non-finite entry go, as do
    null ids, which can't be named. Of rows that share an id the one with the
    least vector counts. Other columns are ignored.
    """
    vector = F.col(vector_col)
    fine = df.where(finite(vector) & F.exists(vector, lambda c: c != 0))
    return one_an_id(fine.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")), "vec_id", "vectors")
