"""Hard negatives by Fagin's threshold algorithm.

A shard of candidates has a sorted list for each dimension. A search reads
all lists from the end that its anchor's sign asks for, scores each row it
meets by all its entries, and stops once the threshold, the score of a row
that would stand where every list is read to, can't reach a window any more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import ship, written
from varve.llm.vectors import finite, length_of, matrix, one_an_id, over_grid

#: Entries of each list read in the first round; rounds double.
FIRST_DEPTH = 64
#: Anchors that one task searches for, about.
ANCHORS_A_BLOCK = 1 << 12


@dataclass(frozen=True)
class Wanted:
    """The k best scores from `low` (None: no bound) to `high` (None: no bound)."""

    k: int
    low: int | None = None
    high: int | None = None


class SortedLists:
    """Integer vectors of a shard, sorted by each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.most = int(np.abs(x).max(initial=0))
        self.plain = x.astype(np.float64)

    def _exact(self, anchor: np.ndarray) -> bool:
        """Whether sums of products fit doubles; beyond 63 bits there is no score at all."""
        most = self.most * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor))
        if most >= 1 << 63:
            raise OverflowError("a score may need more than 64 bits")
        return most < 1 << 53

    def search(self, anchor: np.ndarray, among: np.ndarray, wanted: list[Wanted]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each of `wanted` (ids, scores), best first, ties by smaller id; and how many rows were scored.

        Only rows `among` count. Exact: a row that no list has shown yet
        scores at most the threshold.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        exact = self._exact(anchor)
        seen = ~among
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        open_, depth, step = list(range(len(wanted))), 0, FIRST_DEPTH
        while open_ and depth < n:
            stop = min(n, depth + step)
            if len(up) or len(down):
                met = np.concatenate([self.order[n - stop : n - depth, up].ravel(), self.order[depth:stop, down].ravel()])
            else:  # all scores are 0
                met, stop = np.arange(n), n
            fresh = np.unique(met[~seen[met]])
            seen[fresh] = True
            got = (self.plain[fresh] @ anchor.astype(np.float64)).astype(np.int64) if exact else self.x[fresh] @ anchor
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, got])
            depth, step = stop, 2 * step
            if depth == n:
                break
            threshold = int(self.values[n - depth, up] @ anchor[up]) + int(self.values[depth - 1, down] @ anchor[down])
            open_ = [w for w in open_ if not threshold < self._reach(scores, wanted[w])]
        out = []
        for w in wanted:
            inside = np.flatnonzero(self._inside(scores, w))
            inside = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))][: w.k]
            out.append((self.ids[rows[inside]], scores[inside]))
        return out, len(rows)

    @staticmethod
    def _inside(scores: np.ndarray, w: Wanted) -> np.ndarray:
        fine = np.ones(len(scores), dtype=bool)
        if w.low is not None:
            fine &= scores >= w.low
        return fine & (scores <= w.high) if w.high is not None else fine

    @classmethod
    def _reach(cls, scores: np.ndarray, w: Wanted) -> float:
        """The score that an unseen row needs: that of the k-th found, or the window's low end."""
        inside = scores[cls._inside(scores, w)]
        if len(inside) >= w.k:
            return int(np.partition(inside, len(inside) - w.k)[-w.k])
        return w.low if w.low is not None else -float("inf")


def _best(found: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    """The k best of each key, with their rank; a key has at most k rows from each shard."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(other)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` and `anchors`: (vec_id, label, x), integer vectors, one row an id.
    An anchor's positives are its best rows of the same label, other than
    itself; for each the best rows of other labels whose score is between
    both percentages of the positive's (none where that is negative).
    """
    spark = rows.sparkSession
    ship(spark)
    (count, dims), asked = length_of(rows, "x"), anchors.count()
    low, high = percent
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not count or not asked or not dims:
        return nothing

    def shard(left: pa.Table) -> tuple[SortedLists, np.ndarray]:
        return SortedLists(left["vec_id"].to_numpy(), matrix(left["x"], np.int64)), left["label"].to_numpy()

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            lists, labels = shard(left)
            for name, label, x in zip(right["vec_id"].to_numpy(), right["label"].to_numpy(), matrix(right["x"], np.int64)):
                (found,), _ = lists.search(x, (labels == label) & (lists.ids != name), [Wanted(positives)])
                out.append((np.full(len(found[0]), name), *found))
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            lists, labels = shard(left)
            for name, label, x, chosen in zip(right["vec_id"].to_numpy(), right["label"].to_numpy(), matrix(right["x"], np.int64), right["positives"].to_pylist()):
                asked = [(p["positive_id"], p["positive_score"]) for p in chosen if p["positive_score"] >= 0]
                windows = [Wanted(negatives, -(-low * s // 100), high * s // 100) for _, s in asked]
                for (other, score), (ids, scores) in zip(asked, lists.search(x, labels != label, windows)[0]):
                    out.append((np.full(len(ids), name), np.full(len(ids), other), np.full(len(ids), score), ids, scores))
        return _table(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = "anchor_id long, positive_id long, positive_score long"
    found = over_grid(rows, anchors, "vec_id", "vec_id", count, asked, ANCHORS_A_BLOCK, nearest, schema)
    chosen = written(_best(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    lists = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    found = over_grid(rows, anchors.join(lists, "vec_id"), "vec_id", "vec_id", count, asked, ANCHORS_A_BLOCK, hard, f"{schema}, negative_id long, negative_score long")
    best = _best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0)] * len(names)
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)


def integer_rows(df: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """A written table (vec_id, label, x) of integer vectors, one row an id.

    Rows with a null label, a null vector or a null or non-finite entry go, as
    do null ids, which can't be named. Of rows that share an id the one with
    the least (label, x) counts, so a repeated row counts once. Ties of scores
    go to the smaller id. Other columns are ignored; vectors of several
    lengths are an error later on.
    """
    fine = df.where(F.col(label_col).isNotNull() & finite(F.col(vector_col)))
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale))
    return one_an_id(fine.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x")), "vec_id", "integers")


#: What the query has to give, by all pairs.
SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
