"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects the same number of copies, target over
source size. With documents in order of size (ties by md5 of the id), the
prefix sum of expected copies is rank times that number; one offset for each
source is added, and a document is emitted once per integer its prefix sum
crosses. Order by size makes the words taken come near the target.

Ranks need no group in one task: a source is cut at 255 quantiles of the order
key into ranges, counts of ranges are summed up, and rows are only numbered
within their range. Equal sizes are told apart by the md5, so a group of
copies is cut as well. The rank doesn't depend on where the cuts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import WORD, below, written

#: Weights by place of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more than so many times its size.
MOST_COPIES = 3
RANGES = 256
#: Sources whose plan (about 8 kB each) goes to all executors at once.
BROADCAST_SOURCES = 1_000
_FRACTION = 1 << 20


def _targets(totals: DataFrame) -> DataFrame:
    """Adds weight and target; totals has one row for each source.

    Water-filling in closed form: in order of 3 * size / weight, sources stop
    at their cap as long as it is below the level that the rest would get.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("weight", weight)
    cap = MOST_COPIES * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), "place")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("level", left.cast("double") / share.cast("double"))
    levels = levels.withColumn("capped", cap / F.col("weight") < F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return levels.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * level)).drop("level", "capped", "place")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows of `docs` as `row` (the columns in `carry`), size, source_size, target, copies.

    size is the number of words (null text: 0). Null is a source of its own,
    the last. A source without words has target 0 and gives no copies.
    Repeated rows are sampled one by one, in an order that all carried columns
    but maps decide, so reruns agree. An empty table gives an empty result. All columns of `docs` travel inside `row`, so their names can't
    clash with those added.
    """
    carry = docs.columns if carry is None else carry
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    fraction = F.conv(F.substring(md5, 1, 5), 16, 10).cast("double") / _FRACTION
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(source_col).alias("source"), size.alias("size"),
        (size + fraction).alias("key"), md5.alias("tie"), F.xxhash64(text_col, *(F.col(f"`{c}`") for c in carry if "map<" not in docs.schema[c].dataType.simpleString())).alias("tie2"),
    )
    if text_col not in carry:
        rows = written(rows, "sizes")  # else the words of every text would be counted in each of the passes below
    cuts = [i / RANGES for i in range(1, RANGES)]
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.percentile_approx("key", cuts, 5_000).alias("cuts"))
    place = below(F.col("cuts"), F.col("key"), RANGES - 1)
    salts = 16
    hint = F.broadcast if totals.select("source").count() <= BROADCAST_SOURCES else lambda df: df
    salt = F.pmod(F.xxhash64("tie"), F.lit(salts))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Join by source; a hot source is spread over salts where this shuffles."""
        if hint is F.broadcast:
            return left.join(hint(right.withColumnRenamed("source", "its")), F.col("source").eqNullSafe(F.col("its"))).drop("its")
        right = right.withColumnRenamed("source", "its").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return left.withColumn("salt", salt).join(right, F.col("source").eqNullSafe(F.col("its")) & (F.col("salt") == F.col("part"))).drop("its", "part", "salt")

    counts = beside(rows.select("source", "key", "tie"), totals.select("source", "cuts")).groupBy("source", place.alias("range")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    starts = starts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("range", "before"))).alias("starts"))
    plan = _targets(totals).join(starts.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")

    placed = beside(rows, plan).withColumn("range", place)
    within = Window.partitionBy("source", "range").orderBy("size", "tie", "tie2")
    rank = (F.col("starts")[F.col("range")] + F.row_number().over(within)).cast("double")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 6), 16, 10).cast("double") / float(1 << 24)
    ranked = placed.select("row", "source", "size", "source_size", "target", rank.alias("rank"), expected.alias("expected"), offset.alias("offset"))
    crossed = F.floor(F.col("rank") * F.col("expected") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("expected") + F.col("offset"))
    return ranked.select("row", "size", "source_size", "target", F.least(crossed, F.lit(MOST_COPIES)).cast("long").alias("copies"))


def mixed(docs: DataFrame, **columns: str) -> DataFrame:
    """`docs` with each row as often as the mix takes it, same columns."""
    plan = mix_plan(docs, **columns).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: DuckDB SQL for the columns of op9_source_mixing.
SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS tie
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals
), weighted AS (
  SELECT *, ([5, 2, 1])[((place - 1) % 3 + 1)::INT] AS weight FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighted
  WINDOW w AS (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, 3 * source_size / weight < level AS at_cap FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN at_cap THEN (3 * source_size)::DOUBLE
         ELSE weight * max(CASE WHEN NOT at_cap THEN level END) OVER () END AS target
  FROM capped
), numbered AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie))::DOUBLE AS r,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
         ('0x' || substr(md5(coalesce(d.source, '')), 1, 6))::BIGINT::DOUBLE / 16777216.0 AS o
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * least(floor(r * e + o) - floor((r - 1) * e + o), 3))::BIGINT AS taken
FROM numbered
"""
