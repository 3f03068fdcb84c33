"""Telemetry: typed values, as-of labels, interval joins, exposition text, OTLP shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.keys import NS_PER_HOUR


def route_values(df: DataFrame) -> DataFrame:
    """vtype 0 goes to val_i, others to val_d, exactly one not null; absent devices are -1."""
    out = df.withColumn("val_i", F.when(F.col("vtype") == 0, F.floor("value").cast("long"))).withColumn("val_d", F.when(F.col("vtype") != 0, F.col("value").cast("decimal(18,6)")))
    out = out.where(F.col("val_i").isNotNull() != F.col("val_d").isNotNull())
    return out.withColumn("gpu", F.coalesce("gpu", F.lit(-1))).withColumn("inst", F.coalesce("inst", F.lit(-1)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, width: int = NS_PER_HOUR) -> DataFrame:
    """`left` with the value of the newest right row at or before it, by key.

    Time is cut into buckets of `width`, so a key with most of the rows is as
    many groups as it has buckets. Of each bucket the last value is carried
    forward over the key's buckets (one row each), and rows are ordered within
    their bucket only, the carried value first. At equal times right rows come
    first; right rows without a value count for nothing.
    """
    columns = left.columns
    a = left.withColumn("_time", F.col(left_time)).withColumn("_right", F.lit(0)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.where(F.col(value).isNotNull()).select(*keys, F.col(right_time).alias("_time"), F.lit(-1).alias("_right"), F.col(value).alias("_value"))
    bucket = F.floor(F.col("_time") / F.lit(width)) if width < 1 << 20 else F.expr(f"_time div {width}L")
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", bucket)
    last = both.groupBy(*keys, "_bucket").agg(F.max(F.when(F.col("_right") < 0, F.struct("_time", "_value")))["_value"].alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_bucket", F.lit(None).cast(both.schema["_time"].dataType).alias("_time"), F.lit(-2).alias("_right"), F.last("_last", ignorenulls=True).over(before).alias("_value"))
    order = Window.partitionBy(*keys, "_bucket").orderBy(F.asc_nulls_first("_time"), "_right").rowsBetween(Window.unboundedPreceding, 0)
    whole = both.unionByName(carried, allowMissingColumns=True).withColumn(value, F.last("_value", ignorenulls=True).over(order))
    return whole.where("_right = 0").select(*columns, value)


def activations(df: DataFrame, index: str, value: str) -> DataFrame:
    """One row for each sparse activation; rows whose arrays disagree with nnz go."""
    fine = df.where((F.size(index) == F.size(value)) & (F.size(index) == F.col("nnz")))
    return fine.withColumn("_pair", F.explode(F.arrays_zip(index, value))).select("*", F.col(f"_pair.{index}").alias("feature"), F.col(f"_pair.{value}").alias("strength")).drop("_pair", index, value)


def windows_of(operations: DataFrame, key: str, time: str, hour_ns: int, place: list[str] | None = None) -> DataFrame:
    """From and to of each operation, one row for each hour (or other stretch of `hour_ns`) it covers.

    `place` are the columns that tell where it ran (device, instance); an
    operation that ran at several places has a window at each.
    """
    spans = operations.groupBy(key, *(place or [])).agg(F.min(time).alias("from_ns"), F.max(time).alias("to_ns"))
    return spans.withColumn("epoch_hour", F.explode(F.sequence(F.expr(f"from_ns div {hour_ns}"), F.expr(f"to_ns div {hour_ns}"))))


def interval_join(points: DataFrame, spans: DataFrame, time: str, place: list[str] | None = None) -> DataFrame:
    """Points within spans: an equi join by hour and place with the range as its condition.

    A span whose place is null (work on an external queue) claims no device
    and gets no points.
    """
    on = ["epoch_hour", *(place or [])]
    return points.join(spans, on).where((F.col(time) >= F.col("from_ns")) & (F.col(time) <= F.col("to_ns")))


LABEL = r'([a-zA-Z_]\w*)="((?:[^"\\]|\\.)*)"'
SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"


def exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels, value) of exposition text; comments and bad lines are left out."""
    line = F.regexp_replace(column, r"^\s+|\s+$", "")
    rows = lines.where(~line.startswith("#")).select(line.alias("line")).where(F.col("line").rlike(SAMPLE))
    found = lambda group: F.regexp_extract_all(F.regexp_extract("line", SAMPLE, 2), F.lit(LABEL), F.lit(group))
    pairs = F.zip_with(found(1), found(2), lambda k, v: F.struct(k.alias("key"), F.replace(v, F.lit('\\"'), F.lit('"')).alias("value")))
    # of a name that occurs again the last value counts
    last = F.filter(F.col("pairs"), lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["key"] == p["key"]))
    number = F.expr(f"try_cast(regexp_extract(line, r'{SAMPLE}', 3) AS double)")
    rows = rows.withColumn("pairs", pairs)
    return rows.select(F.regexp_extract("line", SAMPLE, 1).alias("name"), F.map_from_entries(last).alias("labels"), number.alias("value")).where("value IS NOT NULL")


def otlp(samples: DataFrame, service: str, now_ns: int, most: int = 10_000) -> DataFrame:
    """JSON documents of about `most` points of one metric each: gauges, or monotonic sums for counters."""
    metric = ["name", "unit", "kind"]
    sizes = samples.groupBy(*metric).agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = samples.join(sizes, metric).withColumn("_part", F.pmod(F.xxhash64("labels", "value"), F.col("_parts")))
    point = F.struct(F.col("labels").alias("attributes"), F.lit(now_ns).alias("timeUnixNano"), F.col("value").alias("asDouble"))
    points = dealt.groupBy(*metric, "_part").agg(F.array_sort(F.collect_list(point)).alias("dataPoints"))
    body = F.when(F.col("kind") == "counter", F.to_json(F.struct("name", "unit", F.struct("dataPoints", F.lit(True).alias("isMonotonic"), F.lit(2).alias("aggregationTemporality")).alias("sum"))))
    body = body.otherwise(F.to_json(F.struct("name", "unit", F.struct("dataPoints").alias("gauge"))))
    return points.select("name", "kind", F.size("dataPoints").alias("points"), F.lit(service).alias("service"), body.alias("metric"))
