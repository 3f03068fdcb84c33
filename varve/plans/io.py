"""Files and streams made from the given tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import keys
from varve.operators import tiers
from varve.registry import query
from varve.session import shared_dir, table
from varve.sources import files
from varve.streaming import landing


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/varve-io-{uuid.uuid4().hex}"


@query("a01_csv_columns", """WITH n AS (SELECT * FROM (SELECT *, row_number() OVER () AS r FROM nation) WHERE r <= 5), p AS (SELECT * FROM (SELECT *, row_number() OVER () AS r FROM supplier) WHERE r <= 5)
SELECT 'nation' AS source_table, c AS column_name, string_agg(v, ',' ORDER BY r) AS "values", 'n_nationkey,geo.n_name,n_regionkey' AS headers FROM (SELECT r, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS c, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS v FROM n) GROUP BY c
UNION ALL SELECT 'supplier', c, coalesce(string_agg(v, ',' ORDER BY r), ''), 's_suppkey,s_name,s_acctbal' FROM (SELECT r, unnest(['s_suppkey', 's_name', 's_acctbal']) AS c, unnest([s_suppkey::VARCHAR, s_name, NULL]) AS v FROM p) GROUP BY c""")
def csv_columns(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    n = table(spark, sf, "nation").withColumnRenamed("n_name", "geo.n_name").select("n_nationkey", "`geo.n_name`", "n_regionkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("s_acctbal"))
    for name, df in (("nation.csv", n), ("supplier.csv", s), ("metadata.csv", n)):
        df.coalesce(1).write.csv(f"{folder}/{name}", header=True)
    found = files.csv_columns(spark, folder)
    return found.select("source_table", "column_name", F.array_join("sample_values", ",").alias("values"), F.array_join("headers", ",").alias("headers"))


@query("a02_column_records", "SELECT p_brand AS source_table, p_type AS column_name, string_agg(p_name, ',' ORDER BY p_name) AS \"values\", p_type || ',other' AS headers FROM part GROUP BY ALL")
def column_records(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("source_table"), F.col("p_type").alias("column_name")).agg(F.to_json(F.collect_list("p_name")).alias("sample_values"))
    p = p.withColumn("column_type", F.lit("STRING")).withColumn("sibling_columns", F.to_json(F.array(F.col("column_name"), F.lit("other"))))
    found = files.column_records(p)
    return found.select("source_table", "column_name", F.array_join(F.array_sort("sample_values"), ",").alias("values"), F.array_join("headers", ",").alias("headers"))


@query("a04_csv_landing", "SELECT s_suppkey::VARCHAR AS supp_key, s_name AS col_2name, s_nationkey::VARCHAR AS nation FROM supplier")
def csv_landing(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/x_data.csv"
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Supp-Key"), F.col("s_name").alias("2Name!"), F.col("s_nationkey").alias(" Nation"))
    s.write.csv(path, header=True)
    return files.land_csv(spark, path)


def _package(spark: SparkSession, sf: str) -> files.Package:
    p = files.Package(spark, _folder(spark))
    for service, name in (("geo", "region"), ("geo", "nation"), ("sales", "customer"), ("geo", "region")):
        p.ingest(table(spark, sf, name), service, name, f"{sf}/{name}.parquet")
    return p


@query("a05_package_ingest", "SELECT 'geo' AS service, 'region' AS name, count(*) AS rows FROM region UNION ALL SELECT 'geo', 'nation', count(*) FROM nation UNION ALL SELECT 'sales', 'customer', count(*) FROM customer")
def package_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return _package(spark, sf).manifest().select("service", "name", "rows")


@query("a06_package_services", "SELECT 'geo' AS service, 2 AS tables, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'sales', 1, count(*) FROM customer")
def package_services(spark: SparkSession, sf: str) -> DataFrame:
    return _package(spark, sf).services()


@query("a07_package_verify", "SELECT 'geo' AS service, 'nation' AS name, 'row count differs' AS problem UNION ALL SELECT 'geo', 'stray', 'not in the manifest'")
def package_verify(spark: SparkSession, sf: str) -> DataFrame:
    p = _package(spark, sf)
    table(spark, sf, "nation").where("n_nationkey > 3").write.mode("overwrite").parquet(f"{p.folder}/geo/nation.parquet")
    table(spark, sf, "region").write.parquet(f"{p.folder}/geo/stray.parquet")
    return p.verify()


@query("a08_package_sql", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def package_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _package(spark, sf).sql("SELECT r_name, count(*) AS customers FROM sales__customer JOIN geo__nation ON c_nationkey = n_nationkey JOIN geo__region ON n_regionkey = r_regionkey GROUP BY 1")


@query("a09_gpu_samples", "SELECT epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) // 3600000000 AS epoch_hour, g AS gpu_index, value + g AS power_w FROM events, (SELECT unnest([0, 1]) AS g) WHERE event_id % 10 <> 3 AND event_id >= 100")
def gpu_samples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    gpu = lambda i: F.struct(F.lit(i).alias("i"), (F.col("value") + i).alias("w"))
    line = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), F.array(gpu(0), gpu(1)).alias("gpus")))
    folder = _folder(spark)
    e.select(F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(line).alias("value")).write.text(folder)
    rows = files.gpu_samples(spark.read.text(folder))
    old = rows.where(F.col("ts_ns") <= e.where("event_id = 99").agg(F.max(keys.micros("ts")) * 1000).first()[0])
    return files.newer(rows, old).select("ts_ns", "epoch_hour", "gpu_index", "power_w")


@query("a12_hour_overwrite", "SELECT epoch_us(ts) // 3600000000 % 24 AS epoch_hour, count(*) AS n, count(*) FILTER (epoch_us(ts) // 3600000000 % 24 < 5) AS rewritten FROM events GROUP BY 1")
def hour_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    rows = table(spark, sf, "events").select(F.expr("unix_micros(cast(ts AS timestamp)) div 3600000000 % 24").alias("epoch_hour"), "event_id", F.lit(0).alias("version"))
    tiers.write_hours(rows, path, ["event_id"])
    tiers.write_hours(rows.where("epoch_hour < 5").withColumn("version", F.lit(1)), path, ["event_id"])
    return spark.read.parquet(path).groupBy(F.col("epoch_hour").cast("long").alias("epoch_hour")).agg(F.count("*").alias("n"), F.sum("version").alias("rewritten"))


@query("a15_ground_truth", "SELECT p_type AS key, max(p_brand) AS code FROM part GROUP BY 1")
def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    files.write_ground_truth(table(spark, sf, "part").groupBy(F.col("p_type").alias("key")).agg(F.max("p_brand").alias("code")), path)
    return files.ground_truth(spark, path)


@query("a16_catalog", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def catalog(spark: SparkSession, sf: str) -> DataFrame:
    entries = [("db", "nation", "ICEBERG", {"path": "gone"}, 1), ("db", "nation", "KUDU", {"path": f"{sf}/nation.parquet"}, 2), ("db", "region", "KUDU", {"path": f"{sf}/region.parquet"}, 1), ("db", "by_region", "VIEW", {"sql": "SELECT r_name, count(*) AS n FROM db__nation JOIN db__region ON n_regionkey = r_regionkey GROUP BY 1"}, 1)]
    files.Catalog(spark.createDataFrame(entries, files.Catalog.SCHEMA + ", at int")).serve()
    return spark.table("db__by_region")


@query("b22_answers", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 AND k = 0 THEN 'n0' ELSE 'c' || k END AS column_name, 'x' || (p_partkey + k) AS code, 0.5 AS confidence FROM part, (SELECT unnest([0, 1]) AS k) WHERE p_partkey % 5 <> 4")
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Stored responses in the shapes that models give."""
    item = lambda k: F.format_string('{"column_name": "%s", "category_code": "x%d", "confidence": 0.5}', F.when((F.col("p_partkey") % 4 == 1) & F.lit(k == 0), "").otherwise(f"c{k}"), F.col("p_partkey") + k)
    array = F.concat(F.lit("["), item(0), F.lit(", "), item(1), F.lit("]"))
    kind = F.col("p_partkey") % 5
    response = F.when(kind == 0, array).when(kind == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here you are: "), array, F.lit(" - done"))).when(kind == 3, F.concat(item(0), F.lit("\nand\n"), item(1))).otherwise("no idea")
    return files.answers(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.lit("n0"), F.lit("n1")).alias("names"), response.alias("response")))


# --- streams; the same rows as a batch gives


def _event_stream(spark: SparkSession, sf: str, files: int = 2) -> tuple[DataFrame, str]:
    """events as files, some rows twice with a later value, and a stream over them."""
    folder = _folder(spark)
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value", F.lit(0).alias("seq"))
    again = e.where("event_id % 5 = 0").withColumn("value", F.col("value") + 1).withColumn("seq", F.lit(1))
    e.unionByName(again).repartition(6, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    return stream, folder


_HOUR = "unix_micros(ts) div 3600000000"


@query("g1_stream_landing", "SELECT event_id, epoch_us(ts) // 3600000000 AS epoch_hour, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value FROM events")
def stream_landing(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-batches merge into the hours they touch; the later value of a repeated event stays."""
    stream, folder = _event_stream(spark, sf)
    landing.land_hours(stream.withColumn("epoch_hour", F.expr(_HOUR)), f"{folder}/out", f"{folder}/state", ["event_id"], ["seq"])
    return spark.read.parquet(f"{folder}/out").select("event_id", F.col("epoch_hour").cast("long").alias("epoch_hour"), "value")


@query("g1_rolling_bound", "WITH h AS (SELECT event_id, epoch_us(ts) // 3600000000 AS epoch_hour FROM events) SELECT event_id, CASE WHEN epoch_hour >= (SELECT min(epoch_hour) + 300 FROM h) THEN 'landed' ELSE 'late' END AS kind FROM h")
def rolling_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of hours before the bound go to a side table, and no row to both."""
    stream, folder = _event_stream(spark, sf)
    first = table(spark, sf, "events").agg(F.min(keys.micros("ts"))).first()[0] // keys.US_PER_HOUR
    landing.land_hours(stream.where("seq = 0").withColumn("epoch_hour", F.expr(_HOUR)), f"{folder}/out", f"{folder}/state", ["event_id"], ["seq"], settled_before=lambda: first + 300, late_path=f"{folder}/late")
    sides = [spark.read.parquet(f"{folder}/{side}").select("event_id", F.lit(kind).alias("kind")) for side, kind in (("out", "landed"), ("late", "late"))]
    return sides[0].unionByName(sides[1])


@query("g2_stream_hours", "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, sum(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM events GROUP BY ALL")
def stream_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by hour in update mode, with a watermark wide enough for files in any order."""
    stream, folder = _event_stream(spark, sf)
    landing.land(landing.hourly(stream, ["event_type"], late="60 days"), f"{folder}/out", f"{folder}/state", mode="update")
    return landing.landed(spark, f"{folder}/out", ["hour", "event_type"], []).select(F.unix_micros("hour").alias("hour_us"), "event_type", "n")


@query("g4_stream_changes", "SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered changes by key, merged into the buckets they touch; an error deletes."""
    stream, folder = _event_stream(spark, sf)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    landing.project(stream.where("seq = 0").withColumn("op", op), f"{folder}/out", f"{folder}/state", ["user_id"], ["event_id"])
    return landing.projected(spark, f"{folder}/out").select("user_id", "event_id")


@query("g5_stream_sketches", "SELECT event_type, sum(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS n, count(DISTINCT date_trunc('hour', ts)) AS hours, true AS near FROM events GROUP BY 1")
def stream_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly sketches of event ids, merged by type: repeated events count once, within 5 % of the exact number."""
    stream, folder = _event_stream(spark, sf)
    sketches = landing.pattern_sketches(stream, "event_type", "event_id", late="60 days")
    landing.land(sketches, f"{folder}/out", f"{folder}/state", mode="update")
    last = landing.landed(spark, f"{folder}/out", ["hour", "event_type"], [])
    merged = last.groupBy("event_type").agg(F.sum("n").alias("n"), F.countDistinct("hour").alias("hours"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("event_id").alias("exact"))
    return merged.join(exact, "event_type").select("event_type", "n", "hours", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("g2_closed_hours", """WITH w AS (SELECT (epoch_us(max(ts)) // 1000 - 7200000) AS ms FROM events) SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, sum(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS n
FROM events, w WHERE epoch_us(date_trunc('hour', ts)) // 1000 + 3600000 <= ms GROUP BY ALL""")
def stream_closed_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of hours that the watermark (two hours) has closed, each given once."""
    stream, folder = _event_stream(spark, sf, files=1_000)
    landing.land(landing.hourly(stream, ["event_type"]), f"{folder}/out", f"{folder}/state")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out").select(F.unix_micros("hour").alias("hour_us"), "event_type", "n")


@query("g3_stream_timers", """WITH l AS (SELECT user_id, max(epoch_us(ts)) // 1000 AS ms, arg_max(event_type, (epoch_us(ts) // 1000, event_type = 'error')) AS last FROM events GROUP BY 1), w AS (SELECT max(epoch_us(ts)) // 1000 - 7200000 AS ms FROM events)
SELECT user_id, CASE WHEN last = 'error' THEN 'released' WHEN l.ms + 86400000 < w.ms THEN 'lapsed' ELSE 'alive' END AS state, l.ms AS heartbeat FROM l, w""")
def stream_timers(spark: SparkSession, sf: str) -> DataFrame:
    """Leases that lapse by a timer a day after their last heartbeat; an error releases."""
    stream, folder = _event_stream(spark, sf, files=1_000)
    beats = stream.select("user_id", "ts", (F.col("event_type") == "error").alias("released"))
    landing.land(landing.liveness(beats, "user_id", "ts", 86_400_000), f"{folder}/out", f"{folder}/state", mode="update")
    return landing.landed(spark, f"{folder}/out", ["user_id"], ["heartbeat"]).select("user_id", "state", "heartbeat")


@query("g6_late_rows", """WITH w AS (SELECT max(epoch_us(ts)) // 1000 - 7200000 AS ms FROM events WHERE event_id % 4 <> 1)
SELECT event_id, CASE WHEN event_id % 4 = 1 AND epoch_us(ts) // 1000 < w.ms THEN 'late' ELSE 'landed' END AS kind FROM events, w""")
def late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the events comes after the others: what the watermark has passed goes to the side table, the rest lands."""
    folder = _folder(spark)
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    for part in ("event_id % 4 <> 1", "event_id % 4 = 1"):
        e.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in").withColumn("epoch_hour", F.expr(_HOUR))
        landing.land_with_late(stream, f"{folder}/out", f"{folder}/late", f"{folder}/state", ["event_id"], ["ts"])
    sides = [spark.read.parquet(f"{folder}/{side}").select("event_id", F.lit(kind).alias("kind")) for side, kind in (("out", "landed"), ("late", "late"))]
    return sides[0].unionByName(sides[1])


@query("g6_without_repeats", "SELECT event_id FROM events")
def without_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Of events that a stream repeats within the watermark one passes."""
    stream, folder = _event_stream(spark, sf)
    landing.land(landing.without_repeats(stream, ["event_id"], late="60 days"), f"{folder}/out", f"{folder}/state")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out").select("event_id")


@query("a03_benchmark_columns", """WITH p AS (SELECT p_brand || '_' || p_size AS t, p_partkey AS r, p_name, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_type END AS p_type FROM part), big AS (SELECT t FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT regexp_replace(t, '_[0-9]+$', '') AS source_table, 'p_type' AS column_name, coalesce(array_to_string((list(p_type ORDER BY r) FILTER (trim(p_type) <> ''))[1:5], ','), '') AS sample, 'p_name' AS siblings, CASE WHEN t LIKE 'Brand#1%' AND regexp_replace(t, '_[0-9]+$', '') = 'Brand#1' THEN 'c1' END AS code
FROM p WHERE t IN (SELECT t FROM big) GROUP BY t""")
def benchmark_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat_ws("_", "p_brand", "p_size").alias("table"), F.col("p_partkey").alias("row"), "p_name", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_type")).alias("p_type"))
    cells = p.unpivot(["table", "row"], ["p_name", "p_type"], "header", "value").withColumn("ordinal", F.when(F.col("header") == "p_name", 0).otherwise(1))
    targets = cells.where("ordinal = 1").select("table", "ordinal").distinct()
    found = files.benchmark_columns(cells, targets, spark.createDataFrame([("Brand#1.p_type", "c1")], "key string, code string"))
    return found.select("source_table", "column_name", F.array_join("sample_values", ",").alias("sample"), F.array_join("sibling_columns", ",").alias("siblings"), "code")


@query("a14_run_report", """WITH d AS (SELECT o_orderpriority AS code, o_orderkey % 7 = 0 AS n, o_orderkey % 10 / 10.0 AS k FROM orders)
SELECT count(*) AS columns, round(avg(n::INT), 4) AS clarify, round(avg(k), 4) AS mean_conflict, (SELECT '{' || string_agg('"' || code || '":' || c, ',' ORDER BY code) || '}' FROM (SELECT code, count(*) AS c FROM d GROUP BY 1)) AS codes FROM d""")
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as classified columns, written with a fixed schema and reported on."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("code"), (F.col("o_orderkey") % 7 == 0).alias("needs_clarification"), (F.col("o_orderkey") % 10 / 10.0).alias("conflict"), F.col("o_orderkey").alias("left_out"))
    schema = {"code": "string", "confidence": "double", "conflict": "double", "needs_clarification": "boolean"}
    return files.run_report(files.write_classified(o, _folder(spark), schema))


@query("g3_stream_liveness", """WITH l AS (SELECT user_id, max(event_id) AS heartbeat, arg_max(event_type, event_id) AS last FROM events GROUP BY 1), n AS (SELECT max(event_id) AS now FROM events)
SELECT user_id, CASE WHEN last = 'error' THEN 'released' WHEN now >= heartbeat + 1000000 OR now - heartbeat >= 20 THEN 'lapsed' ELSE 'alive' END AS state FROM l, n""")
def stream_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Heartbeats through a stream; each micro-batch keeps the last of a lease, liveness is read off at a given time."""
    from varve.operators import claims

    stream, folder = _event_stream(spark, sf)
    landing.land(stream.where("seq = 0"), f"{folder}/out", f"{folder}/state", transform=lambda b: tiers.latest(b, ["user_id"], ["event_id"]))
    last = landing.landed(spark, f"{folder}/out", ["user_id"], ["event_id"])
    now = last.agg(F.max("event_id")).first()[0]
    leases = last.select("user_id", F.col("event_id").alias("heartbeat"), (F.col("event_type") == "error").alias("released"), (F.col("event_id") + 1_000_000).alias("horizon"), F.lit(20).alias("ttl"))
    return claims.lease_state(leases, now).select("user_id", "state")
