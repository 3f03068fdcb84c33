"""Keys, tiers, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import keys
from varve.operators import keyed, tiers
from varve.plans import fixtures as fx
from varve.registry import query
from varve.session import table

W = f"WITH {fx.SQL} "
VIEW = "view_all AS (SELECT * FROM hot UNION ALL SELECT * FROM settled WHERE epoch_hour NOT IN (SELECT epoch_hour FROM hot GROUP BY 1))"


@query("flagship", f"""WITH {fx.SQL}, {VIEW},
hourly AS (SELECT epoch_hour, series_id, gpu, count(*) AS n, sum(floor(value * 100)::BIGINT) AS cents FROM view_all GROUP BY ALL)
SELECT h.epoch_hour, s.name, h.gpu, h.n, h.cents FROM hourly h JOIN series s USING (series_id)""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Tiered view, hourly totals by series and device, names from the dimension."""
    view = tiers.union_view(fx.hot(spark, sf), fx.settled(spark, sf))
    hourly = view.groupBy("epoch_hour", "series_id", "gpu").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))
    return hourly.join(fx.series(spark, sf), "series_id").select("epoch_hour", "name", "gpu", "n", "cents")


@query("b01_hours", W + """SELECT event_id, epoch_hour, epoch_hour - epoch_hour % 168 AS week_start, epoch_hour - epoch_hour % 24 AS day_start,
epoch_hour - epoch_hour % 168 - 672 AS settle_before FROM readings""")
def hours(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.readings(spark, sf)
    return r.select("event_id", keys.epoch_hour("ts_ns").alias("epoch_hour"), keys.week_start_hour("epoch_hour").alias("week_start"), keys.day_start_hour("epoch_hour").alias("day_start"), keys.settle_before_hour("epoch_hour").alias("settle_before"))


_MINT = """minted AS (
  SELECT event_id, ms, n, lpad(to_hex(ms + n // 4096), 12, '0') AS h, md5(event_id::VARCHAR) AS noise
  FROM (SELECT event_id, epoch_us(ts) // 60000000 * 60000 AS ms, row_number() OVER (PARTITION BY epoch_us(ts) // 60000000 ORDER BY event_id) - 1 AS n FROM events)
), uuids AS (
  SELECT event_id, lower(h[1:8] || '-' || h[9:12] || '-7' || lpad(to_hex(n % 4096), 3, '0') || '-' || ('89ab')[(('0x' || noise[1:1])::INT % 4) + 1] || noise[2:4] || '-' || noise[5:16]) AS uuid, ms, n FROM minted
)"""


def _minted(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of events, all those of a minute as if they came in its first millisecond."""
    e = table(spark, sf, "events").select("event_id", (F.floor(keys.micros("ts") / 60_000_000) * 60_000).alias("ms"))
    return keys.mint_uuid7(e, "ms", "event_id")


@query("b02_uuid7_mint", f"WITH {_MINT} SELECT event_id, uuid FROM uuids")
def mint(spark: SparkSession, sf: str) -> DataFrame:
    return _minted(spark, sf).select("event_id", "uuid")


@query("b03_uuid7_parts", f"WITH {_MINT} SELECT event_id, ms + n // 4096 AS ms, (ms + n // 4096) // 3600000 AS hour, (ms + n // 4096) // 86400000 AS day FROM uuids")
def uuid_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _minted(spark, sf).select("event_id", keys.uuid7_millis("uuid").alias("ms"), keys.uuid7_hour("uuid").alias("hour"), keys.uuid7_day("uuid").alias("day"))


@query("b04_uuid7_quarantine", f"""WITH {_MINT}, ids AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN uuid[1:14] || '4' || uuid[16:] WHEN 1 THEN 'tx-' || event_id WHEN 2 THEN NULL ELSE uuid END AS id FROM uuids)
SELECT event_id, id AS offending, CASE event_id % 5 WHEN 0 THEN 'wrong-version' WHEN 1 THEN 'malformed' ELSE 'missing' END AS kind FROM ids WHERE event_id % 5 < 3""")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("event_id") % 5
    fourth = F.concat(F.substring("uuid", 1, 14), F.lit("4"), F.expr("substring(uuid, 16)"))
    bad = F.when(part == 0, fourth).when(part == 1, F.concat(F.lit("tx-"), F.col("event_id"))).when(part > 2, F.col("uuid"))
    _, out = keys.quarantine(_minted(spark, sf).withColumn("id", bad), "id", "landing")
    return out.select("event_id", "issue.offending", "issue.kind")


@query("b07_value_routing", W + """SELECT event_id, CASE WHEN vtype = 0 THEN floor(value)::BIGINT END AS val_i, CASE WHEN vtype = 1 THEN round(value * 1000000)::BIGINT END AS val_micro,
coalesce(gpu, -1) AS gpu, inst FROM readings""")
def routing(spark: SparkSession, sf: str) -> DataFrame:
    from varve.operators.telemetry import route_values

    return route_values(fx.readings(spark, sf)).select("event_id", "val_i", F.round(F.col("val_d").cast("double") * 1_000_000).cast("long").alias("val_micro"), "gpu", "inst")


@query("b16_digest_keys", "SELECT event_id, sha256(event_type || chr(31) || user_id)[1:32] AS digest FROM events")
def digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", keys.digest_key("event_type", "user_id").alias("digest"))


@query("b17_soft_delete", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0")
def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("removed", (F.col("s_acctbal") < 0).cast("tinyint"))
    return s.where("removed = 0").select("s_suppkey", "s_name")


@query("b18_closed_hours", W + "SELECT epoch_hour, count(*) AS n, epoch_hour < h + 600 AS closed, epoch_hour < (h + 600) - (h + 600) % 168 - 168 AS settleable FROM readings, h0 GROUP BY ALL")
def closed_hours(spark: SparkSession, sf: str) -> DataFrame:
    now = fx.first_hour(spark, sf) + 600
    counts = tiers.hour_counts(fx.readings(spark, sf))
    return counts.select("epoch_hour", "n", (F.col("epoch_hour") < now).alias("closed"), (F.col("epoch_hour") < now - now % 168 - 168).alias("settleable"))


@query("b21_day_windows", """SELECT day::DATE AS day, isoyear(day) || '-W' || lpad(week(day)::VARCHAR, 2, '0') AS week,
epoch_us(day) * 1000 AS from_ns, epoch_us(day + INTERVAL 1 DAY) * 1000 AS to_ns
FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM orders)""")
def day_windows(spark: SparkSession, sf: str) -> DataFrame:
    span = table(spark, sf, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    start = F.unix_micros(F.col("day").cast("timestamp")) * 1000
    return days.select("day", keys.iso_week("day").alias("week"), start.alias("from_ns"), (start + 24 * keys.NS_PER_HOUR).alias("to_ns"))


@query("c01_tier_mask", f"WITH {fx.SQL}, {VIEW} SELECT event_id, epoch_hour, series_id, gpu FROM view_all")
def tier_mask(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.union_view(fx.hot(spark, sf), fx.settled(spark, sf)).select("event_id", "epoch_hour", "series_id", "gpu")


@query("c02_series_names", W + "SELECT s.name, s.vtype, count(*) AS n, count(DISTINCT gpu) AS gpus FROM readings r JOIN series s USING (series_id) GROUP BY ALL")
def series_names(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.readings(spark, sf).drop("vtype").join(fx.series(spark, sf), "series_id")
    return r.groupBy("name", "vtype").agg(F.count("*").alias("n"), F.countDistinct("gpu").alias("gpus"))


@query("c03_settle_state", W + """, verified AS (SELECT epoch_hour, count(*) AS rows FROM hot GROUP BY 1 HAVING epoch_hour % 10 <> 3),
present AS (SELECT epoch_hour, count(*) AS n FROM hot GROUP BY 1)
SELECT p.epoch_hour // 24 AS day, count(*) AS present, sum(CASE WHEN n = rows THEN 1 ELSE 0 END)::BIGINT AS verified, bool_and(coalesce(n = rows, false)) AS droppable
FROM present p LEFT JOIN verified v USING (epoch_hour) GROUP BY 1""")
def settle_state(spark: SparkSession, sf: str) -> DataFrame:
    h = fx.hot(spark, sf)
    verified = tiers.hour_counts(h).where("epoch_hour % 10 <> 3").withColumnRenamed("n", "rows")
    return tiers.settle_state(h, verified)


@query("c04_reconcile", W + """, s AS (SELECT epoch_hour, count(*) AS settled_n FROM settled WHERE event_id % 97 <> 5 GROUP BY 1), k AS (SELECT epoch_hour, count(*) AS hot_n FROM hot GROUP BY 1),
b AS (SELECT epoch_hour, coalesce(hot_n, 0) AS hot_n, coalesce(settled_n, 0) AS settled_n FROM k FULL JOIN s USING (epoch_hour))
SELECT b.*, CASE WHEN epoch_hour >= h + 600 THEN 'live' WHEN hot_n = 0 THEN 'settled' WHEN settled_n = 0 THEN 'analog' WHEN settled_n < hot_n THEN 'refuse' WHEN settled_n > hot_n THEN 'extra' ELSE 'drop' END AS verdict FROM b, h0""")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    short = fx.settled(spark, sf).where("event_id % 97 <> 5")
    return tiers.reconcile(fx.hot(spark, sf), short, fx.first_hour(spark, sf) + 600)


@query("d01_hour_counts", W + "SELECT epoch_hour, count(*) AS n FROM hot GROUP BY 1")
def hour_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.hour_counts(fx.hot(spark, sf))


@query("d35_consistency", W + """, s AS (SELECT * FROM settled WHERE epoch_hour < (SELECT h + 432 FROM h0) OR event_id % 3 = 0)
SELECT (SELECT count(*) FROM hot) AS hot_rows, (SELECT count(DISTINCT epoch_hour) FROM hot) AS hot_parts, (SELECT count(*) FROM s) AS settled_rows, (SELECT count(DISTINCT epoch_hour) FROM s) AS settled_parts,
x AS shared, 0::BIGINT AS repeated, CASE WHEN x > 0 THEN 'keys in both tiers' ELSE '' END AS errors, x = 0 AS passed FROM (SELECT count(*) AS x FROM (SELECT event_id FROM hot INTERSECT SELECT event_id FROM s))""")
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.settled(spark, sf).where((F.col("epoch_hour") < fx.first_hour(spark, sf) + fx.HOT_FROM) | (F.col("event_id") % 3 == 0))
    return tiers.consistency(fx.hot(spark, sf), s, "event_id", "epoch_hour")


@query("d39_freshness", W + "SELECT event_type, (SELECT max(ts_ns) + 1000 FROM hot) - max(ts_ns) AS lag_ns, count(*) AS n FROM hot GROUP BY 1")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    h = fx.hot(spark, sf)
    return tiers.freshness(h, h.agg(F.max("ts_ns")).first()[0] + 1000, "event_type")


@query("d39_name_list", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def name_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("e01_latest", W + "SELECT user_id, arg_max(event_id, (ts_ns, event_id)) AS event_id FROM readings GROUP BY 1")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.latest(fx.readings(spark, sf), ["user_id"], ["ts_ns", "event_id"]).select("user_id", "event_id")


@query("a11_upsert", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value FROM events")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "value").withColumn("seq", F.lit(0))
    changes = e.where("event_id % 5 = 0").withColumn("value", F.col("value") + 1).withColumn("seq", F.lit(1))
    return tiers.upsert(e, changes, ["event_id"], ["seq"]).select("event_id", "value")


@query("f02_set_operations", W + """SELECT 'both' AS kind, count(*) AS n FROM (SELECT event_id FROM hot INTERSECT SELECT event_id FROM settled)
UNION ALL SELECT 'hot only', count(*) FROM (SELECT event_id FROM hot EXCEPT SELECT event_id FROM settled)
UNION ALL SELECT 'settled only', count(*) FROM (SELECT event_id FROM settled EXCEPT SELECT event_id FROM hot)
UNION ALL SELECT 'all', (SELECT count(*) FROM hot) + (SELECT count(*) FROM settled)""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    a, b = fx.hot(spark, sf).select("event_id"), fx.settled(spark, sf).select("event_id")
    parts = {"both": a.intersect(b), "hot only": a.join(b, "event_id", "left_anti"), "settled only": b.join(a, "event_id", "left_anti"), "all": a.unionByName(b)}
    out = None
    for kind, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("f05_multiset_equality", "WITH a AS (SELECT user_id, event_type FROM events), b AS (SELECT user_id, CASE WHEN event_id % 100 = 1 THEN 'other' ELSE event_type END AS event_type FROM events) "
"SELECT user_id, event_type, 'left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT user_id, event_type, 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL")
def multisets(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that one of two runs has more often; equal runs give none."""
    e = table(spark, sf, "events")
    a = e.select("user_id", "event_type")
    b = e.select("user_id", F.when(F.col("event_id") % 100 == 1, "other").otherwise(F.col("event_type")).alias("event_type"))
    left, right = a.exceptAll(b).withColumn("side", F.lit("left")), b.exceptAll(a).withColumn("side", F.lit("right"))
    return left.unionByName(right).groupBy("user_id", "event_type", "side").agg(F.count("*").alias("n"))


@query("t1_upkeep_plan", W + """SELECT name AS "table", c + 168 AS add_from, c + 336 AS add_to, c - 672 AS settle_before, 'ADD RANGE ' || (c + 168) || ' TO ' || (c + 336) || ' OF ' || name AS statement
FROM series, (SELECT max(epoch_hour) - max(epoch_hour) % 168 AS c FROM readings)""")
def upkeep_plan(spark: SparkSession, sf: str) -> DataFrame:
    now = fx.readings(spark, sf).agg(F.max("epoch_hour")).first()[0]
    return tiers.upkeep_plan(spark, fx.series(spark, sf).select(F.col("name").alias("table")), now)


def _settle(spark: SparkSession, sf: str, df: DataFrame, now: int) -> DataFrame:
    from varve.session import shared_dir
    import uuid

    path = f"{shared_dir(spark)}/varve-tier-{uuid.uuid4().hex}"
    return tiers.settle_hours(spark, df.drop("vtype"), path, now, ["series_id", "ts_ns"])


@query("t2_settle_hours", W + "SELECT epoch_hour, count(*) AS rows, count(*) AS written, true AS verified FROM hot, h0 WHERE epoch_hour < h + 600 GROUP BY 1")
def settle_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _settle(spark, sf, fx.hot(spark, sf), fx.first_hour(spark, sf) + 600)


@query("t3_drop_days", W + """, v AS (SELECT epoch_hour FROM hot GROUP BY 1 HAVING epoch_hour % 10 <> 3), d AS (SELECT h.epoch_hour // 24 AS day FROM hot h LEFT JOIN v USING (epoch_hour) GROUP BY 1 HAVING count(*) = count(v.epoch_hour))
SELECT event_id, hot.epoch_hour FROM hot WHERE epoch_hour // 24 NOT IN (SELECT day FROM d)""")
def drop_days(spark: SparkSession, sf: str) -> DataFrame:
    h = fx.hot(spark, sf)
    verified = tiers.hour_counts(h).where("epoch_hour % 10 <> 3").withColumnRenamed("n", "rows")
    return tiers.drop_days(h, verified).select("event_id", "epoch_hour")


def _folder(spark: SparkSession) -> str:
    import uuid

    from varve.session import shared_dir

    return f"{shared_dir(spark)}/varve-lifecycle-{uuid.uuid4().hex}"


_SORT = ["series_id", "ts_ns"]
_ONCE = "WITH runs AS (SELECT epoch_hour, count(*) AS n, count(*) FILTER (event_id % 50 <> 7) AS early FROM hot, h0 WHERE epoch_hour < h + 600 GROUP BY 1)"


@query("t2_settle_state", W + _ONCE.replace("WITH runs", ", runs") + " SELECT epoch_hour, n AS rows, n AS written, true AS verified, CASE WHEN early = n THEN 1 ELSE 2 END::BIGINT AS run FROM runs")
def settle_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, the second with rows that came late: only their hours settle again."""
    h, folder, now = fx.hot(spark, sf).drop("vtype"), _folder(spark), fx.first_hour(spark, sf) + 600
    tiers.settle_hours(spark, h.where("event_id % 50 <> 7"), f"{folder}/settled", now, _SORT, state_path=f"{folder}/state", run=1)
    tiers.settle_hours(spark, h, f"{folder}/settled", now, _SORT, state_path=f"{folder}/state", run=2)
    return tiers.state_of(spark, f"{folder}/state").select("epoch_hour", "rows", "written", "verified", "run")


@query("t2_late_after_removal", W + """, c AS (SELECT epoch_hour, count(*) AS n, count(*) FILTER (event_id % 50 = 7) AS late FROM hot, h0 WHERE epoch_hour < h + 600 GROUP BY 1 HAVING count(*) > count(*) FILTER (event_id % 50 = 7)),
o AS (SELECT epoch_hour, count(*) AS n FROM hot, h0 WHERE epoch_hour < h + 600 GROUP BY 1 HAVING count(*) = count(*) FILTER (event_id % 50 = 7))
SELECT epoch_hour, n AS rows, true AS verified, CASE WHEN late > 0 THEN 2 ELSE 1 END::BIGINT AS run FROM c UNION ALL SELECT epoch_hour, n, true, 2 FROM o""")
def late_after_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Days leave the hot tier, late rows land in their hours, and what settles again has the old rows and the late ones."""
    h, folder, now = fx.hot(spark, sf).drop("vtype"), _folder(spark), fx.first_hour(spark, sf) + 600
    for run, rows in ((1, h.where("event_id % 50 <> 7")), (2, h.where("event_id % 50 = 7"))):
        tiers.upsert_hours(spark, f"{folder}/hot", rows, ["event_id"], ["ts_ns"])
        tiers.apply_lifecycle(spark, f"{folder}/hot", f"{folder}/settled", f"{folder}/state", f"{folder}/stamps", now, run, _SORT, keys=["event_id"])
    there = tiers.hour_counts(spark.read.parquet(f"{folder}/settled")).select(F.col("epoch_hour").cast("long").alias("epoch_hour"), F.col("n").alias("rows"))
    return there.join(tiers.state_of(spark, f"{folder}/state").select("epoch_hour", "rows", "verified", "run"), ["epoch_hour", "rows"])


@query("t3_remove_days", W + """, c AS (SELECT epoch_hour, epoch_hour // 24 AS day, count(*) AS rows, count(*) FILTER (event_id % 10 = 7 AND epoch_hour // 24 % 3 = 1) AS late FROM hot GROUP BY 1),
d AS (SELECT day FROM c, h0 GROUP BY 1 HAVING bool_and(late = 0 AND epoch_hour < h + 600)) SELECT day, epoch_hour, rows, 5::BIGINT AS "at" FROM c WHERE day IN (SELECT day FROM d)""")
def remove_days(spark: SparkSession, sf: str) -> DataFrame:
    """Of a written hot tier, days whose hours are all verified as they are now go; the stamps tell which."""
    h, folder = fx.hot(spark, sf).drop("vtype"), _folder(spark)
    tiers.write_hours(h, f"{folder}/hot", _SORT)
    tiers.settle_hours(spark, h.where("NOT (event_id % 10 = 7 AND epoch_hour div 24 % 3 = 1)"), f"{folder}/settled", fx.first_hour(spark, sf) + 600, _SORT, state_path=f"{folder}/state", run=1)
    for at in (5, 6):  # the second finds them gone
        tiers.remove_days(spark, f"{folder}/hot", f"{folder}/state", f"{folder}/stamps", at)
    return spark.read.parquet(f"{folder}/stamps")


@query("t4_apply", W + """, c AS (SELECT epoch_hour, epoch_hour // 24 AS day, count(*) AS rows FROM hot GROUP BY 1), closed AS (SELECT c.*, epoch_hour < h + 590 AS over FROM c, h0), d AS (SELECT day FROM closed GROUP BY 1 HAVING bool_and(over))
SELECT 'settled' AS step, epoch_hour, rows, NULL::VARCHAR AS problem FROM closed WHERE over UNION ALL SELECT 'removed', epoch_hour, rows, NULL FROM closed WHERE day IN (SELECT day FROM d)
UNION ALL SELECT 'leftover', epoch_hour, rows, 'day not over' FROM closed WHERE over AND day NOT IN (SELECT day FROM d)""")
def apply_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    tiers.write_hours(fx.hot(spark, sf).drop("vtype"), f"{folder}/hot", _SORT)
    return tiers.apply_lifecycle(spark, f"{folder}/hot", f"{folder}/settled", f"{folder}/state", f"{folder}/stamps", fx.first_hour(spark, sf) + 590, 1, _SORT)


@query("t6_backfill", W + "SELECT epoch_hour, count(*) AS rows, count(*) AS written, true AS verified FROM hot, h0 WHERE epoch_hour BETWEEN h + 440 AND h + 520 GROUP BY 1")
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    first = fx.first_hour(spark, sf)
    return tiers.backfill(spark, fx.hot(spark, sf).drop("vtype"), f"{_folder(spark)}/settled", first + 440, first + 520, _SORT)


@query("a11_upsert_hours", W + "SELECT event_id, epoch_hour, CASE WHEN epoch_hour % 7 = 2 AND event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM readings")
def upsert_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Changes land in a written tier; hours without changes keep their files."""
    path = f"{_folder(spark)}/tier"
    r = fx.readings(spark, sf).select("event_id", "epoch_hour", "ts_ns", "value").withColumn("seq", F.lit(0))
    tiers.write_hours(r, path, ["event_id"])
    changes = r.where("epoch_hour % 7 = 2 AND event_id % 3 = 0").withColumn("value", F.col("value") + 1).withColumn("seq", F.lit(1))
    tiers.upsert_hours(spark, path, changes, ["event_id"], ["seq"])
    return spark.read.parquet(path).select("event_id", F.col("epoch_hour").cast("long").alias("epoch_hour"), "value")


_MOVED = "SELECT event_id, CASE WHEN event_id % 7 = 3 THEN epoch_hour + 5 ELSE epoch_hour END AS epoch_hour, CASE WHEN event_id % 7 = 3 OR event_id % 11 = 4 THEN value + 1 ELSE value END AS value FROM readings"


@query("a11_moved_keys", W + _MOVED)
def moved_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that give a key another hour, and others that don't; each key has one row afterwards."""
    return _moved(spark, sf).rows().select("event_id", "epoch_hour", "value")


@query("a11_compacted", W + _MOVED.replace("SELECT event_id", ", m AS (SELECT event_id", 1) + ") SELECT count(*) AS n, count(*) AS stored, 0::BIGINT AS deletes, round(sum(value), 2) AS value FROM m")
def compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The same tier once compacted: no row is stored twice and no delete is left."""
    tier = _moved(spark, sf)
    tier.compact()
    return tier.rows().agg(F.count("*").alias("n"), F.lit(tier.stored()).cast("long").alias("stored"), F.lit(tier.deletes().count()).cast("long").alias("deletes"), F.round(F.sum("value"), 2).alias("value"))


def _moved(spark: SparkSession, sf: str) -> keyed.KeyedTier:
    r = fx.readings(spark, sf).select("event_id", "epoch_hour", "value").withColumn("seq", F.lit(0))
    tier = keyed.KeyedTier(spark, f"{_folder(spark)}/keyed", ["event_id"], ["seq"], r.schema)
    tier.land(r, 1)
    moved = F.when(F.col("event_id") % 7 == 3, F.col("epoch_hour") + 5).otherwise(F.col("epoch_hour"))
    tier.land(r.where("event_id % 7 = 3 OR event_id % 11 = 4").withColumn("epoch_hour", moved).withColumn("value", F.col("value") + 1).withColumn("seq", F.lit(1)), 2)
    return tier


@query("t5_consolidate", W + "SELECT CASE WHEN epoch_hour < h + 500 THEN 'settled' ELSE 'hot' END AS tier, count(*) AS n, count(DISTINCT epoch_hour) AS hours FROM hot, h0 GROUP BY ALL")
def consolidate(spark: SparkSession, sf: str) -> DataFrame:
    """Cold hours move to the settled tier and leave the hot one."""
    cut = fx.first_hour(spark, sf) + 500
    h = fx.hot(spark, sf)
    moved = _settle(spark, sf, h, cut).where("verified").select("epoch_hour")
    tier = h.join(moved.withColumn("moved", F.lit(True)), "epoch_hour", "left").withColumn("tier", F.when(F.col("moved"), "settled").otherwise("hot"))
    return tier.groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("epoch_hour").alias("hours"))
