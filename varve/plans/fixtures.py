"""Warehouse tables derived from the given ones, the same way in Spark and in SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.functions import keys
from varve.session import table

#: Hours of the hot tier start here after the first hour; settled ones end 48 hours later.
HOT_FROM, SETTLED_TO = 432, 480


def series(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension of event types: a handful of rows."""
    kinds = table(spark, sf, "events").select("event_type").distinct()
    number = F.row_number().over(Window.orderBy("event_type"))
    return kinds.select(number.cast("long").alias("series_id"), F.col("event_type").alias("name"), F.when(F.col("event_type").isin("click", "view", "signup"), 0).otherwise(1).alias("vtype"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """events as telemetry: hour, nanoseconds, series, device, routed value."""
    e = table(spark, sf, "events").withColumn("us", keys.micros("ts"))
    e = e.join(series(spark, sf), F.col("event_type") == F.col("name"))
    return e.select(
        "event_id", F.expr(f"us div {keys.US_PER_HOUR}").alias("epoch_hour"), (F.col("us") * 1000).alias("ts_ns"), "series_id", "vtype",
        (F.col("user_id") % 6).cast("int").alias("gpu"), F.lit(-1).alias("inst"), "user_id", "event_type", "value",
    )


@cache
def _first_hour(spark: SparkSession, sf: str, application: str) -> int:
    us = table(spark, sf, "events").agg(F.min(keys.micros("ts"))).first()[0]
    return us // keys.US_PER_HOUR


def first_hour(spark: SparkSession, sf: str) -> int:
    """The first hour of a table, looked up once in an application: hot and settled rows are both told by it."""
    return _first_hour(spark, sf, spark.sparkContext.applicationId)


def hot(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).where(F.col("epoch_hour") >= first_hour(spark, sf) + HOT_FROM)


def settled(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).where(F.col("epoch_hour") < first_hour(spark, sf) + SETTLED_TO)


SQL = f"""
series AS (
  SELECT row_number() OVER (ORDER BY event_type) AS series_id, event_type AS name,
         CASE WHEN event_type IN ('click', 'view', 'signup') THEN 0 ELSE 1 END AS vtype
  FROM (SELECT DISTINCT event_type FROM events)
), readings AS (
  SELECT event_id, epoch_us(ts) // {keys.US_PER_HOUR} AS epoch_hour, epoch_us(ts) * 1000 AS ts_ns, series_id, vtype,
         (user_id % 6)::INT AS gpu, -1 AS inst, user_id, event_type, value
  FROM events JOIN series ON event_type = name
), h0 AS (SELECT min(epoch_hour) AS h FROM readings),
hot AS (SELECT r.* FROM readings r, h0 WHERE epoch_hour >= h + {HOT_FROM}),
settled AS (SELECT r.* FROM readings r, h0 WHERE epoch_hour < h + {SETTLED_TO})
"""

# --- facts: customers and their orders as entity, attribute, value, transaction


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """e, a, v, t, op, ts_ns: an order asserts its customer's state, or retracts it."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("e"), F.concat(day, F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("t"),
        (F.col("o_orderstatus") != "F").alias("op"), (keys.micros("o_orderdate") * 1000).alias("ts_ns"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.col("o_orderpriority").alias("priority"),
    )
    return rows.unpivot(["e", "t", "op", "ts_ns"], ["segment", "nation", "priority"], "a", "v")


FACTS_SQL = """
rows AS (
  SELECT c_custkey AS e, strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 10, '0') AS t,
         o_orderstatus <> 'F' AS op, epoch_us(o_orderdate) * 1000 AS ts_ns,
         c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey
), facts AS (
  SELECT e, t, op, ts_ns, 'segment' AS a, segment AS v FROM rows
  UNION ALL SELECT e, t, op, ts_ns, 'nation', nation FROM rows
  UNION ALL SELECT e, t, op, ts_ns, 'priority', priority FROM rows
)
"""


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as operations: tx_id, turn, agent, time."""
    base = first_hour(spark, sf) * keys.NS_PER_HOUR
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("tx_id"), "turn", F.col("role").alias("agent"), F.length("text").alias("chars"), (F.lit(base) + F.col("conv_id") * keys.NS_PER_HOUR + F.col("turn") * 1_000_000_000).alias("ts_ns"))


TX_SQL = f"""
base AS (SELECT min(epoch_us(ts)) // {keys.US_PER_HOUR} * {keys.NS_PER_HOUR} AS b FROM events),
tx AS (
  SELECT conv_id AS tx_id, turn, role AS agent, length(text) AS chars, b + conv_id * {keys.NS_PER_HOUR} + turn * 1000000000 AS ts_ns
  FROM conversations, base
)
"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """events as forecasts; some unresolved, some corrected later (is_correction)."""
    e = table(spark, sf, "events")
    last = F.expr("event_id % 10")
    rows = e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("observer"), F.concat(F.lit("s"), F.expr("user_id % 4")).alias("state"),
        F.concat(F.lit("rev"), F.expr("user_id % 2")).alias("engine_rev"), F.expr("cast(floor(value) AS bigint) % 10 / 10.0").cast("double").alias("p"),
        F.when(last == 3, F.lit(None)).otherwise(F.expr("cast(floor(value * 100) AS bigint) % 2 = 0")).alias("outcome"), F.lit(False).alias("is_correction"),
        (F.col("user_id") % 50).alias("proposition"), keys.micros("ts").alias("us"), last.alias("last"),
    )
    early = F.col("id") % 70 == 7  # these corrections come before their observation
    fixes = rows.where("last = 7").withColumn("seq", F.when(early, -F.col("id")).otherwise(F.col("id") + 1_000_000_000)).withColumn("outcome", ~F.col("outcome")).withColumn("is_correction", F.lit(True))
    return rows.unionByName(fixes).drop("last")


LEDGER_SQL = """
obs AS (
  SELECT event_id AS id, event_id AS seq, event_type AS observer, 's' || (user_id % 4) AS state, 'rev' || (user_id % 2) AS engine_rev,
         (floor(value)::BIGINT % 10) / 10.0 AS p,
         CASE WHEN event_id % 10 = 3 THEN NULL ELSE floor(value * 100)::BIGINT % 2 = 0 END AS outcome,
         false AS is_correction, user_id % 50 AS proposition, epoch_us(ts) AS us
  FROM events
), ledger AS (
  SELECT * FROM obs UNION ALL
  SELECT id, CASE WHEN id % 70 = 7 THEN -id ELSE id + 1000000000 END, observer, state, engine_rev, p, NOT outcome, true, proposition, us
  FROM obs WHERE id % 10 = 7
)
"""
