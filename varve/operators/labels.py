"""Labels of columns: propagation, ground truth from headers, paths, bootstrap figures, importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from varve.session import ship, written

# --- fixed values: codes that suggest an element when two or more occur in a table
AFFINITIES = {"PaymentCard": ("0070", "0073", "0075"), "CustomerIdentity": ("0085", "0084", "0073"), "FinancialAccount": ("0071", "0070", "0073"), "EmployeeRecord": ("0085", "0073", "0026")}
#: From these figures a label is passed on, and contested.
SIMILARITY, PAIR_LEAST, PAIR_BELOW, PAIR_FACTOR, CONTESTED = 0.85, 0.35, 0.50, 0.9, 0.2
# --- end of fixed values
#: Vectors that cut sources into cells, and sources of a block.
PIVOTS, CELL_ROWS = 64, 1_000
#: The first sources by place, which every target meets at once, and targets that meet sources by one product.
FIRST, SIDE = 1_000, 1_000
#: Parquet's reader holds a row group, and a block is one row.
GROUP = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4"}


def refine_elements(codes: DataFrame, known: DataFrame) -> DataFrame:
    """(element, source_table, column_name): tables with two or more codes of an affinity, unless the element is known.

    `codes` has source_table, column_name, code; of several tables that
    suggest an element the first by name has it.
    """
    pairs = codes.sparkSession.createDataFrame([(e, c) for e, cs in AFFINITIES.items() for c in cs], "element string, code string")
    hits = codes.join(F.broadcast(pairs), "code").join(known.select("element"), "element", "left_anti")
    tables = hits.groupBy("element", "source_table").agg(F.countDistinct("code").alias("k")).where("k >= 2")
    first = tables.groupBy("element").agg(F.min("source_table").alias("source_table"))
    return hits.join(F.broadcast(first), ["element", "source_table"]).select("element", "source_table", "column_name")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def candidates(targets: DataFrame, sources: DataFrame, similarity: float = SIMILARITY, pivots: int = PIVOTS, floor: float | None = None) -> DataFrame:
    """(item, place, code, confidence, guess, guess_confidence, sim): similar pairs; with `floor` only the first of each block of sources that a target doesn't refuse.

    `pivots` sources cut the others into cells by their nearest one; a cell
    knows its widest angle. A target meets a cell only if its angle to the
    pivot is at most that and the angle of `similarity` together, as angles
    keep the triangle inequality. So no similar pair is missed. Both sides are
    packed into blocks by cell, large cells by a hash too, and a block of
    targets meets all sources of a block by one product.
    """
    spark = targets.sparkSession
    ship(spark)
    centres = sources.select("vector").distinct().withColumn("_hash", F.xxhash64("vector")).orderBy("_hash", "vector").limit(pivots)
    cosines = _cosines([r.vector for r in centres.select("vector").collect()])  # a bounded number of vectors
    nearest = F.array_position("_cos", F.array_max("_cos")).cast("int")
    near = sources.withColumn("_cos", cosines).withColumn("_cell", nearest).withColumn("_far", _angle(F.array_max("_cos"))).drop("_cos")
    near = written(near.where("_cell IS NOT NULL"), "cells")
    cells = written(near.groupBy("_cell").agg(F.max("_far").alias("_far"), F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_parts")), "radii")
    reach = math.acos(similarity) + 1e-9
    met = [F.when(_angle(F.element_at("_cos", r._cell)) <= r._far + reach, F.lit(r._cell)) for r in cells.collect()]  # no more than pivots
    asked = targets.withColumn("_cos", cosines).withColumn("_cell", nearest).withColumn("_met", F.array_compact(F.array(*met)).cast("array<int>"))
    asked = written(asked.select("item", "guess", "guess_confidence", "vector", "_cell", "_met").where(F.size("_met") > 0), "asked")
    parts = asked.groupBy("_cell").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("_parts"))
    asked = _dealt(asked, parts, ["item", "vector"]).agg(F.collect_list(F.struct("item", "guess", "guess_confidence", F.col("vector").cast("array<double>"))).alias("_targets"), F.array_distinct(F.flatten(F.collect_set("_met"))).alias("_met"))
    blocks = _dealt(near, cells.select("_cell", "_parts"), ["place", "code"]).agg(F.sort_array(F.collect_list(F.struct("place", "code", "confidence", F.col("vector").cast("array<double>")))).alias("_sources"))
    asked, blocks = written(asked.select("_targets", "_met"), "targets", **GROUP), written(blocks.select("_cell", "_sources"), "sources", **GROUP)
    types = {**{f.name: f.dataType for f in (*targets.schema, *sources.schema)}, "sim": DoubleType()}
    schema = StructType([StructField(n, types[n]) for n in ("item", "place", "code", "confidence", "guess", "guess_confidence", "sim")])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, others in zip(*batch.columns):
                (item, guess, sure, own), (place, code, confidence, wide) = some.values.flatten(), others.values.flatten()
                own, wide = (v.flatten().to_numpy().reshape(len(v), -1) for v in (own, wide))
                good = _similar(own, wide, similarity)
                if floor is not None:
                    good &= ~_refused(guess.to_pylist(), sure.cast("double").to_numpy(zero_copy_only=False), code.to_pylist(), floor)
                    a = np.flatnonzero(good.any(axis=1))
                    b = good[a].argmax(axis=1)
                else:
                    a, b = np.nonzero(good)
                x, y = pa.array(a), pa.array(b)
                yield pa.record_batch([item.take(x), place.take(y), code.take(y), confidence.take(y), guess.take(x), sure.take(x), pa.array(_sums(own[a], wide[b]))], schema.names)

    return asked.join(blocks, F.array_contains("_met", F.col("_cell"))).select("_targets", "_sources").mapInArrow(match, schema)


def _cosines(centres: list) -> Column:
    """Products of `vector` and each centre, null where one of them has a null or they differ in length."""
    whole = [v if v is not None and None not in v else [] for v in centres]

    @F.pandas_udf("array<double>")
    def products(vectors: pd.Series) -> pd.Series:
        out = [None] * len(vectors)
        for width in {len(v) for v in whole if v}:
            fits = [len(v) == width for v in whole]
            at = [i for i, v in enumerate(vectors) if v is not None and len(v) == width]
            found = np.array([vectors[i] for i in at], dtype=float).reshape(-1, width) @ np.array([v for v, f in zip(whole, fits) if f], dtype=float).T
            for i, some in zip(at, found):
                cosines = iter(some)
                out[i] = some if all(fits) else [next(cosines) if f else None for f in fits]
        return pd.Series(out, dtype=object)

    return products(_whole("vector"))


def _whole(name: str) -> Column:
    own = F.col(name).cast("array<double>")
    return F.when(~F.exists(own, lambda x: x.isNull()), own)


def _dealt(rows: DataFrame, parts: DataFrame, names: list[str]) -> GroupedData:
    """Rows of a cell in its parts, by a hash of the named columns; few bytes make many pairs, so tasks aren't joined by size."""
    part = F.pmod(F.xxhash64(*names), F.col("_parts")).cast("int")
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.join(F.broadcast(parts), "_cell").withColumn("_part", part).repartition(tasks, "_cell", "_part").groupBy("_cell", "_part")


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row, added up in the order of the dimensions, as `_dot` does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _similar(own: np.ndarray, wide: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of the one are similar to which of the other: by a product; what is next to the bound is decided as `_dot` decides."""
    sims = own @ wide.T
    a, b = np.nonzero(~(np.abs(sims - similarity) > 1e-9))
    sims[a, b] = _sums(own[a], wide[b])
    return ~(sims < similarity)


def _refused(guesses: list, sure: np.ndarray, codes: list, floor: float) -> np.ndarray:
    """Which targets refuse which codes: those with another guess of more than `floor`."""
    place: dict = {}
    wanted = np.array([-1 if g is None else place.setdefault(g, len(place)) for g in guesses], dtype=int)
    named = np.array([-2 if c is None else place.setdefault(c, len(place)) for c in codes], dtype=int)
    return (wanted[:, None] != named) & ((wanted >= 0) & (sure > floor))[:, None]


def propagate(targets: DataFrame, sources: DataFrame, floor: float = 0.5, similarity: float = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """(item, code, confidence): unlabelled targets take the label of the first source that is similar.

    targets: item, vector (unit length), guess, guess_confidence; sources:
    place, vector, code, confidence. A target whose own guess disagrees with
    more than `floor` refuses that source. Sources are labels given directly,
    not passed on. Every target meets the FIRST sources by place in one pass;
    only those that none of these fits go on to the pairs of `candidates`, as
    a later place can't come before.
    """
    spark, names = targets.sparkSession, ["item", "vector", "guess", "guess_confidence"]
    first = sources.orderBy("place", "code").limit(FIRST).collect()  # a bounded number of rows
    head = spark.createDataFrame([(i, *r) for i, r in enumerate(first)], StructType([StructField("_at", LongType()), *sources.schema.fields]))
    met = written(targets.select(*names).withColumn("_at", _first_similar(spark, [r.vector for r in first], [r.code for r in first], floor, similarity)), "met")
    sure = met.where("_at >= 0").join(F.broadcast(head.select("_at", F.col("vector").alias("_own"), "place", "code", "confidence")), "_at")
    found = sure.select("item", F.struct("place", "code", (_dot("vector", "_own") * F.col("confidence")).alias("confidence")).alias("best"))
    rest = met.where("_at < 0").drop("_at")
    if len(first) == FIRST and not rest.isEmpty():
        both = candidates(rest, sources, similarity, pivots, floor)
        found = found.unionByName(both.select("item", F.struct("place", "code", (F.col("sim") * F.col("confidence")).alias("confidence")).alias("best")))
    return found.groupBy("item").agg(F.min("best").alias("best")).select("item", "best.code", "best.confidence")


def _first_similar(spark: SparkSession, vectors: list, codes: list, floor: float, similarity: float) -> Column:
    """The place in the list of the first vector that is similar to `vector` and not refused, else -1.

    Products are taken for many targets at once; those next to the bound are
    added up again in the order of the dimensions, so it is decided as `_dot` decides.
    """
    ship(spark)
    whole = [v is not None and None not in v for v in vectors]
    width = max((len(v) for v, w in zip(vectors, whole) if w), default=0)
    fits = np.array([w and len(v) == width for v, w in zip(vectors, whole)], dtype=bool)
    sent = spark.sparkContext.broadcast((np.array([v if f else [0.0] * width for v, f in zip(vectors, fits)], dtype=float).reshape(len(vectors), width), fits, codes))

    def met(own: list, guesses: list, sure: np.ndarray) -> np.ndarray:
        wide, fits, codes = sent.value
        here = np.array([v is not None and len(v) == wide.shape[1] for v in own], dtype=bool)
        own = np.array([v if h else np.zeros(wide.shape[1]) for v, h in zip(own, here)], dtype=float).reshape(len(own), wide.shape[1])
        good = _similar(own, wide, similarity) & here[:, None] & fits & ~_refused(guesses, sure, codes, floor)
        return np.where(good.any(axis=1), good.argmax(axis=1), -1) if len(codes) else np.full(len(own), -1)

    @F.pandas_udf("long")
    def place(own: pd.Series, guess: pd.Series, sure: pd.Series) -> pd.Series:
        guess, sure = guess.astype(object).where(guess.notna(), None), sure.astype(float).to_numpy()
        parts = [met(list(own[i : i + SIDE]), list(guess[i : i + SIDE]), sure[i : i + SIDE]) for i in range(0, len(own), SIDE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, int))

    return place(_whole("vector"), F.col("guess"), F.col("guess_confidence").cast("double"))


def paired(columns: DataFrame) -> DataFrame:
    """An annotation column takes the code of the data column before it, if that is sure and it isn't.

    `columns` has source_table, ordinal, kind, code, confidence. Only data
    columns pass on, so nothing cascades.
    """
    order = Window.partitionBy("source_table").orderBy("ordinal")
    before = {c: F.lag(c).over(order) for c in ("kind", "code", "confidence")}
    take = (F.col("kind") == "annotation") & (before["kind"] == "data") & (before["confidence"] >= PAIR_LEAST) & (F.col("confidence") < PAIR_BELOW)
    take = F.coalesce(take, F.lit(False))
    return columns.select("source_table", "ordinal", F.when(take, before["code"]).otherwise(F.col("code")).alias("code"), F.when(take, before["confidence"] * PAIR_FACTOR).otherwise(F.col("confidence")).alias("confidence"), take.alias("paired"))


def truth_from_headers(tables: DataFrame, codes: DataFrame, suffix: str = r"_(\d{4})$") -> DataFrame:
    """(source_table, column_name, code): an annotation column's code suffix labels the column before it."""
    cells = tables.select("source_table", F.posexplode("headers").alias("place", "header"))
    code = F.regexp_extract("header", suffix, 1)
    rows = cells.withColumn("code", code).withColumn("column_name", F.lag("header").over(Window.partitionBy("source_table").orderBy("place")))
    return rows.where("code <> '' AND column_name IS NOT NULL").join(codes.select("code"), "code", "left_semi").select("source_table", "column_name", "code")


def paths(closure: DataFrame, depth: DataFrame) -> DataFrame:
    """(code, path): ancestors from the leaf to the root, as JSON. depth: (ancestor, depth)."""
    steps = closure.join(depth, "ancestor")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False), lambda s: s["ancestor"])
    return steps.groupBy("code").agg(F.to_json(ordered).alias("path"))


def taxonomy(annotations: DataFrame) -> DataFrame:
    """(code, parent, label, leaf) of dotted codes: deprecated ones go, missing parents are made."""
    live = annotations.where("NOT coalesce(deprecated, false)").select("code", "label")
    parts = F.split("code", r"\.")
    prefixes = live.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("code")).distinct()
    parent = F.when(F.col("code").contains("."), F.regexp_replace("code", r"\.[^.]*$", ""))
    tree = prefixes.join(live, "code", "left").withColumn("parent", parent).withColumn("label", F.coalesce("label", "code"))
    inner = tree.where("parent IS NOT NULL").select(F.col("parent").alias("code")).distinct().withColumn("_inner", F.lit(True))
    return tree.join(inner, "code", "left").select("code", "parent", "label", F.col("_inner").isNull().alias("leaf"))


def bootstrap_figures(columns: DataFrame) -> DataFrame:
    """One row: coverage, mean conflict, disagreements of the two labels with conflict above CONTESTED, filled in."""
    contested = (F.col("label") != F.col("guess")) & (F.col("conflict") > CONTESTED)
    filled = F.col("label").isNull() & (F.col("guess_confidence") >= 0.5)
    return columns.agg(F.round(F.avg(F.col("label").isNotNull().cast("int")), 4).alias("coverage"), F.round(F.avg("conflict"), 4).alias("mean_conflict"), F.count_if(contested).alias("disagreements"), F.count_if(filled).alias("filled"))


def converged(figures: DataFrame, coverage: float = 0.95, conflict: float = CONTESTED) -> DataFrame:
    """Adds converged to figures (coverage, mean_conflict): enough columns have a label, and sources agree."""
    return figures.withColumn("converged", (F.col("coverage") >= coverage) & (F.coalesce("mean_conflict", F.lit(0.0)) < conflict))


def importance(samples: DataFrame, score: Callable[[pd.DataFrame], pd.Series], features: list[str], permutations: int) -> DataFrame:
    """(feature, mean, std): how much the loss grows when a feature is taken from another sample.

    `samples` has place (0 to n - 1), truth and the features. In round k a
    sample gets the feature of the sample k places on, so nothing is drawn at
    random; rows are scored in Arrow batches.
    """
    ship(samples.sparkSession)
    n = samples.count()
    loss = F.pandas_udf(score, "double")
    base = samples.withColumn("loss", loss(F.struct("truth", *features)))
    shifted = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("other", (F.col("place") + F.col("k") * 7919) % n)
    donors = samples.select(F.col("place").alias("other"), *(F.col(f).alias(f"_{f}") for f in features))
    both = shifted.join(donors, "other")
    out = None
    for f in features:
        mixed = both.withColumn("mixed", loss(F.struct("truth", *(F.col(f"_{g}").alias(g) if g == f else F.col(g) for g in features))))
        rounds = mixed.groupBy("k").agg(F.avg(F.col("mixed") - F.col("loss")).alias("gain"))
        row = rounds.agg(F.avg("gain").alias("mean"), F.stddev_pop("gain").alias("std")).select(F.lit(f).alias("feature"), "mean", "std")
        out = row if out is None else out.unionByName(row)
    return out


def top_contributions(items: DataFrame, groups: list[str], k: int) -> DataFrame:
    """(item, place, name, value): raw contributions summed by named group, the k largest by size."""
    name = F.element_at(F.array(*map(F.lit, groups)), F.col("i") + 1)
    long = items.select("item", F.posexplode("contributions").alias("i", "x")).groupBy("item", name.alias("name")).agg(F.sum("x").alias("value"))
    order = Window.partitionBy("item").orderBy(F.abs("value").desc(), "name")
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def governance_name(prefix: str, code: Column, label: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), code, F.lit("_"), F.regexp_replace(label, "[^A-Za-z0-9]", ""))


def sensitivity(df: DataFrame, levels: DataFrame, default: str = "internal") -> DataFrame:
    return df.join(levels, "code", "left").withColumn("level", F.coalesce("level", F.lit(default)))


def metric_names(samples: DataFrame, fields: DataFrame) -> DataFrame:
    """Metric, unit and kind of exported fields; unknown ones are lower-cased gauges of unit 1; labels get gpu. names."""
    out = samples.join(fields, "name", "left")
    labels = F.transform_keys("labels", lambda k, _: F.concat(F.lit("gpu."), F.lower(k)))
    return out.select(F.coalesce("metric", F.lower("name")).alias("metric"), F.coalesce("unit", F.lit("1")).alias("unit"), F.coalesce("kind", F.lit("gauge")).alias("kind"), labels.alias("labels"), "value")


def folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Adds fold: rows of each class in order of md5, dealt in turn.

    Rows are numbered within stretches of the md5, a 4096th of a class each;
    how many rows come before a stretch is summed over the counts alone.
    """
    md5 = F.md5(F.col(key).cast("string"))
    rows = df.withColumn("_md5", md5).withColumn("_part", F.substring("_md5", 1, 3))
    counts = rows.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy(F.col("_part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(label).alias("_label"), F.col("_part").alias("_p"), before.alias("_before"))
    met = F.col(label).eqNullSafe(F.col("_label")) & F.col("_part").eqNullSafe(F.col("_p"))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_md5")) - 1
    return rows.withColumn("_place", place).join(starts, met).withColumn("fold", (F.col("_place") + F.col("_before")) % k).select(*df.columns, "fold")
