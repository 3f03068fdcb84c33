"""Facts, operations, forecasts, telemetry joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import keys
from varve.operators import facts, ledger, telemetry, tiers
from varve.plans import fixtures as fx
from varve.registry import query
from varve.session import table

LIVE = f"WITH {fx.FACTS_SQL}, live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY t DESC, ts_ns DESC, op DESC, v DESC) AS place FROM facts) WHERE place = 1 AND op) "


@query("b05_melt", """SELECT c_custkey AS e, a, v, place FROM (
SELECT c_custkey, 'c_name' AS a, c_name AS v, 0 AS place FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, 1 FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 2 FROM customer WHERE c_custkey % 3 <> 0)""")
def melt(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))).withColumn("_private", F.lit(1)).drop("c_acctbal")
    return facts.melt(c.withColumn("nested", F.array("c_name")), "c_custkey")


_PARTS = "parts AS (SELECT p_partkey AS e, 'kind' AS a, p_type AS v FROM part UNION ALL SELECT p_partkey, 'aspect.size', p_size::VARCHAR FROM part WHERE p_partkey % 2 = 0)"
_REQUIRES = "requires AS (SELECT DISTINCT p_type AS kind, unnest(['size', 'brand']) AS aspect FROM part)"


@query("b06_expand", f"WITH {_PARTS}, {_REQUIRES} SELECT * FROM parts UNION ALL SELECT * FROM (SELECT e, 'aspect.' || aspect AS a, 'declared' AS v FROM parts JOIN requires ON a = 'kind' AND v = kind) w WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.e = w.e AND p.a = w.a)")
def expand(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("e"), F.col("p_type").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).alias("aspect.size"))
    requires = table(spark, sf, "part").select(F.col("p_type").alias("kind"), F.explode(F.array(F.lit("size"), F.lit("brand"))).alias("aspect")).distinct()
    return facts.expand(facts.melt(p, "e").drop("place"), requires)


@query("d02_project", LIVE + "SELECT e, max(CASE WHEN a = 'nation' THEN v END) AS nation, max(CASE WHEN a = 'priority' THEN v END) AS priority, max(CASE WHEN a = 'segment' THEN v END) AS segment, max(t) AS tx_id FROM live GROUP BY e")
def project(spark: SparkSession, sf: str) -> DataFrame:
    return facts.project(fx.facts(spark, sf), ["nation", "priority", "segment"])


@query("d03_project_maps", LIVE + "SELECT e, string_agg(a || '=' || v, ',' ORDER BY a) AS facts, max(t) AS tx_id FROM live GROUP BY e")
def project_maps(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.transform(F.map_entries("facts"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return facts.project_maps(fx.facts(spark, sf)).select("e", F.array_join(entries, ",").alias("facts"), "tx_id")


_RUNS = "runs AS (SELECT o_custkey AS e, lower(o_orderpriority[3:]) AS flow, o_orderkey::VARCHAR AS run, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'file:/tmp/' ELSE 's3://store/' END || o_orderkey AS artifact, o_orderkey AS t FROM orders)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    where = F.when(F.col("o_orderkey") % 7 == 0, "file:/tmp/").otherwise("s3://store/")
    return o.select(F.col("o_custkey").alias("e"), F.lower(F.expr("substring(o_orderpriority, 3)")).alias("flow"), F.col("o_orderkey").cast("string").alias("run"), F.col("o_orderstatus").alias("status"), F.concat(where, F.col("o_orderkey")).alias("artifact"), F.col("o_orderkey").alias("t"))


@query("a17_run_facts", f"""WITH {_RUNS}, ok AS (SELECT * FROM runs WHERE starts_with(artifact, 's3://store/')), newest AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY e, flow ORDER BY t DESC) = 1)
SELECT e, 'run.' || flow || '/' || run || '.status' AS a, status AS v, t FROM ok UNION ALL SELECT e, 'run.' || flow || '/' || run || '.artifact', artifact, t FROM ok
UNION ALL SELECT e, 'latest_' || flow || '_status', status, t FROM newest UNION ALL SELECT e, 'latest_' || flow || '_artifact', artifact, t FROM newest""")
def run_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.run_facts(_runs(spark, sf), "s3://store/")


@query("d04_runs", f"WITH {_RUNS} SELECT e, flow, run, status, artifact FROM runs WHERE starts_with(artifact, 's3://store/')")
def runs(spark: SparkSession, sf: str) -> DataFrame:
    log = facts.run_facts(_runs(spark, sf), "s3://store/").withColumn("op", F.lit(True)).withColumn("ts_ns", F.col("t"))
    return facts.runs(log, ["status", "artifact"])


@query("a13_append_defaults", f"WITH {fx.TX_SQL} SELECT tx_id, turn, CASE WHEN turn % 2 = 0 THEN ts_ns ELSE 7200000000000 END AS ts_ns, CASE WHEN turn % 3 = 0 THEN agent ELSE 'updated' END AS kind, (CASE WHEN turn % 2 = 0 THEN ts_ns ELSE 7200000000000 END) // 3600000000000 AS epoch_hour FROM tx")
def append_defaults(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.transactions(spark, sf).select(F.col("tx_id").cast("string").alias("tx_id"), "turn", F.when(F.col("turn") % 2 == 0, F.col("ts_ns")).alias("ts_ns"), F.when(F.col("turn") % 3 == 0, F.col("agent")).alias("kind"))
    return facts.with_defaults(t, 7_200_000_000_000).withColumn("tx_id", F.col("tx_id").cast("long"))


@query("f03_newest", f"WITH {fx.TX_SQL} SELECT tx_id, turn, ts_ns FROM tx ORDER BY ts_ns DESC, tx_id DESC, turn DESC LIMIT 25")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    return facts.newest(fx.transactions(spark, sf).select("tx_id", "turn", "ts_ns"), 25, ["ts_ns", "tx_id", "turn"])


@query("f04_filtered_list", f"WITH {fx.TX_SQL} SELECT tx_id, turn, ts_ns FROM tx WHERE agent = 'user' AND chars > 40 ORDER BY ts_ns DESC, tx_id DESC, turn DESC LIMIT 500")
def filtered_list(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.transactions(spark, sf).where("agent = 'user' AND chars > 40")
    return t.select("tx_id", "turn", "ts_ns").orderBy(F.desc("ts_ns"), F.desc("tx_id"), F.desc("turn")).limit(500)


@query("c08_operations", f"""WITH {fx.TX_SQL}, t AS (SELECT tx_id, min(ts_ns) AS ts_ns FROM tx GROUP BY 1), x AS (SELECT tx_id, count(*) AS exchanges, sum(chars) AS chars FROM tx WHERE agent = 'user' GROUP BY 1), r AS (SELECT tx_id, count(*) AS reasoning FROM tx WHERE agent <> 'user' GROUP BY 1)
SELECT t.tx_id, ts_ns, exchanges, chars::BIGINT AS chars, reasoning FROM t LEFT JOIN x USING (tx_id) LEFT JOIN r USING (tx_id)""")
def operations(spark: SparkSession, sf: str) -> DataFrame:
    tx = fx.transactions(spark, sf)
    x = tx.where("agent = 'user'").groupBy("tx_id").agg(F.count("*").alias("exchanges"), F.sum("chars").alias("chars"))
    r = tx.where("agent <> 'user'").groupBy("tx_id").agg(F.count("*").alias("reasoning"))
    return facts.operations(tx.groupBy("tx_id").agg(F.min("ts_ns").alias("ts_ns")), x, r)


@query("d37_integrity", "SELECT 'missing aspect' AS problem, p_brand AS id FROM part GROUP BY p_brand HAVING p_brand NOT IN (SELECT 'Brand#' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT 'aspect and product', 'Brand#' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    specs = table(spark, sf, "part").select(F.col("p_brand").alias("aspect"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_suppkey")).alias("id"))
    return facts.integrity(specs, s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 3 = 0"))


# --- telemetry

_LABELS = "labels3 AS (SELECT (user_id % 6)::INT AS gpu, series_id, ts_ns AS valid_from_ns, event_id AS label FROM readings WHERE event_id % 20 = 0)"


@query("c05_as_of", f"WITH {fx.SQL}, {_LABELS} SELECT r.event_id, l.label FROM readings r ASOF LEFT JOIN labels3 l ON r.gpu = l.gpu AND r.series_id = l.series_id AND r.ts_ns >= l.valid_from_ns")
def as_of(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.readings(spark, sf)
    labels = r.where("event_id % 20 = 0").select("gpu", "series_id", F.col("ts_ns").alias("valid_from_ns"), F.col("event_id").alias("label"))
    return telemetry.as_of(r.select("event_id", "gpu", "series_id", "ts_ns"), labels, ["gpu", "series_id"], "ts_ns", "valid_from_ns", "label").select("event_id", "label")


@query("c06_activations", """WITH v AS (SELECT vec_id, label, unnest(range(1, 65)) AS feature, unnest(embedding::DOUBLE[]) AS strength FROM embeddings WHERE vec_id % 9 <> 4)
SELECT vec_id, label, feature - 1 AS feature, round(strength * 10000)::BIGINT AS strength FROM v WHERE strength > 0.15::DOUBLE""")
def activations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("all", F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x")))).withColumn("some", F.filter("all", lambda p: p["x"] > F.lit(0.15).cast("double")))
    sparse = e.select("vec_id", "label", F.col("some.i").alias("feat_idx"), F.col("some.x").alias("feat_val"), (F.size("some") + F.when(F.col("vec_id") % 9 == 4, 1).otherwise(0)).alias("nnz"))
    return telemetry.activations(sparse, "feat_idx", "feat_val").select("vec_id", "label", "feature", F.round(F.col("strength").cast("double") * 10_000).cast("long").alias("strength"))


@query("c07_interval_join", f"""WITH {fx.SQL}, spans AS (SELECT user_id AS tx_id, min(ts_ns) AS from_ns, min(ts_ns) + 7200000000000 AS to_ns FROM readings GROUP BY 1)
SELECT s.tx_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM readings r JOIN spans s ON r.ts_ns BETWEEN from_ns AND to_ns GROUP BY 1""")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.readings(spark, sf)
    ends = r.groupBy(F.col("user_id").alias("tx_id")).agg(F.min("ts_ns").alias("a"))
    marks = ends.select("tx_id", F.explode(F.array("a", F.col("a") + 2 * keys.NS_PER_HOUR)).alias("ts_ns"))
    spans = telemetry.windows_of(marks, "tx_id", "ts_ns", keys.NS_PER_HOUR)
    return telemetry.interval_join(r, spans, "ts_ns").groupBy("tx_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_PLACED = "ran AS (SELECT user_id AS tx_id, CASE WHEN user_id % 5 > 0 THEN gpu END AS gpu, CASE WHEN user_id % 5 > 0 THEN inst END AS inst, min(ts_ns) AS from_ns, min(ts_ns) + 7200000000000 AS to_ns FROM readings GROUP BY ALL)"


@query("c07_device_samples", f"WITH {fx.SQL}, {_PLACED} SELECT tx_id, event_id FROM readings r JOIN ran s ON r.gpu = s.gpu AND r.inst = s.inst AND r.ts_ns BETWEEN from_ns AND to_ns")
def device_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of the device an operation ran on; a fifth of the operations ran on none."""
    r = fx.readings(spark, sf)
    there = F.col("user_id") % 5 > 0
    ran = r.groupBy(F.col("user_id").alias("tx_id"), F.when(there, F.col("gpu")).alias("gpu"), F.when(there, F.col("inst")).alias("inst")).agg(F.min("ts_ns").alias("a"))
    marks = ran.select("tx_id", "gpu", "inst", F.explode(F.array("a", F.col("a") + 2 * keys.NS_PER_HOUR)).alias("ts_ns"))
    spans = telemetry.windows_of(marks, "tx_id", "ts_ns", keys.NS_PER_HOUR, ["gpu", "inst"])
    return telemetry.interval_join(r, spans, "ts_ns", ["gpu", "inst"]).select("tx_id", "event_id")


@query("a10_exposition", "SELECT 'EVENT_' || upper(event_type) AS name, user_id::VARCHAR AS gpu, event_type AS kind, event_id::DOUBLE AS value FROM events WHERE event_id % 10 > 1")
def exposition(spark: SparkSession, sf: str) -> DataFrame:
    """events as scrape lines, with comments and broken lines between them."""
    e = table(spark, sf, "events")
    line = F.format_string('EVENT_%s{gpu="%d",kind="%s"} %d', F.upper("event_type"), "user_id", "event_type", "event_id")
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# HELP "), line)).when(F.col("event_id") % 10 == 1, F.lit("broken{")).otherwise(F.concat(F.lit("  "), line)).alias("value"))
    return telemetry.exposition(lines).select("name", F.col("labels")["gpu"].alias("gpu"), F.col("labels")["kind"].alias("kind"), "value")


@query("d36_otlp", "SELECT event_type AS name, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'counter' ELSE 'gauge' END AS kind, count(*) AS points, sum(round(value * 100))::BIGINT AS cents, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'true/2' ELSE '/' END AS sums FROM events GROUP BY ALL")
def otlp(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.readings(spark, sf)
    samples = r.select(F.col("event_type").alias("name"), F.lit("1").alias("unit"), F.when(F.col("vtype") == 0, "counter").otherwise("gauge").alias("kind"), F.to_json(F.create_map(F.lit("gpu"), F.col("gpu"))).alias("labels"), "value")
    shape = "struct<dataPoints:array<struct<attributes:string,timeUnixNano:long,asDouble:double>>>"
    body = F.from_json("metric", f"name string, unit string, gauge {shape}, sum struct<dataPoints:array<struct<attributes:string,timeUnixNano:long,asDouble:double>>,isMonotonic:boolean,aggregationTemporality:int>")
    metrics = telemetry.otlp(samples, "varve", 0).withColumn("m", body)
    points = F.coalesce("m.sum.dataPoints", "m.gauge.dataPoints")
    cents = F.aggregate(points, F.lit(0).cast("long"), lambda s, p: s + F.round(p["asDouble"] * 100).cast("long"))
    sums = F.concat(F.coalesce(F.col("m.sum.isMonotonic").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("m.sum.aggregationTemporality").cast("string"), F.lit("")))
    documents = metrics.select(F.col("m.name").alias("name"), "kind", F.size(points).alias("points"), cents.alias("cents"), sums.alias("sums"))
    return documents.groupBy("name", "kind", "sums").agg(F.sum("points").alias("points"), F.sum("cents").alias("cents"))


# --- ledger

FOLD = f"""WITH {fx.LEDGER_SQL}, seen AS (SELECT * FROM ledger WHERE NOT is_correction),
fix AS (SELECT c.id, arg_max(c.outcome, c.seq) AS fix FROM ledger c JOIN seen s ON c.id = s.id AND c.is_correction AND c.seq > s.seq GROUP BY 1),
folded AS (SELECT s.* REPLACE (CASE WHEN fix.id IS NOT NULL THEN fix ELSE outcome END AS outcome) FROM seen s LEFT JOIN fix USING (id)) """


@query("d27_corrections", FOLD + "SELECT id, outcome FROM folded")
def corrections(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.folded(fx.ledger(spark, sf)).select("id", "outcome")


@query("d24_brier", FOLD + "SELECT observer, state, engine_rev, count(*) AS n, count(outcome) AS resolved, round(avg((p - outcome::INT) * (p - outcome::INT))::DECIMAL(18, 10), 4)::DOUBLE AS brier FROM folded GROUP BY ALL")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.brier(ledger.folded(fx.ledger(spark, sf)), ["observer", "state", "engine_rev"])


@query("d25_report", FOLD + """SELECT CASE grouping_id(engine_rev, observer, state) WHEN 0 THEN 'both' WHEN 1 THEN 'method' ELSE 'implicit' END AS axis, engine_rev, observer, state,
count(*) AS n, count(outcome) AS resolved, round(avg((p - outcome::INT) * (p - outcome::INT))::DECIMAL(18, 10), 4)::DOUBLE AS brier FROM folded GROUP BY GROUPING SETS ((engine_rev, observer), (engine_rev, state), (engine_rev, observer, state))""")
def report(spark: SparkSession, sf: str) -> DataFrame:
    axes = {"method": ["engine_rev", "observer"], "implicit": ["engine_rev", "state"], "both": ["engine_rev", "observer", "state"]}
    return ledger.report(ledger.folded(fx.ledger(spark, sf)), axes)


@query("d26_trust", FOLD + """, b AS (SELECT observer, state, count(*) AS n, count(outcome) AS resolved, round(avg((p - outcome::INT) * (p - outcome::INT))::DECIMAL(18, 10), 4)::DOUBLE AS brier FROM folded GROUP BY ALL)
SELECT *, round((CASE WHEN brier IS NULL THEN 0.5 ELSE resolved / (resolved + 2.0) * (1 - brier) + 2.0 / (resolved + 2.0) * 0.5 END)::DECIMAL(18, 10), 4)::DOUBLE AS alpha, coalesce(brier, 0.5) AS risk FROM b""")
def trust(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.trust(ledger.brier(ledger.folded(fx.ledger(spark, sf)), ["observer", "state"]))


@query("d28_resolve_open", FOLD + """, f AS (SELECT proposition, outcome, us FROM folded WHERE id % 50 = 1), o AS (SELECT id, proposition, us FROM folded WHERE outcome IS NULL)
SELECT o.id, arg_min(f.outcome, (f.us, f.outcome)) AS outcome, min(f.us) AS us FROM o JOIN f USING (proposition) WHERE f.us >= o.us AND f.us - o.us <= 86400000000 GROUP BY 1""")
def resolve_open(spark: SparkSession, sf: str) -> DataFrame:
    obs = ledger.folded(fx.ledger(spark, sf))
    return ledger.resolve_open(obs, obs.where("id % 50 = 1").select("proposition", "outcome", "us"), 24 * keys.US_PER_HOUR)


@query("d29_ill_posed", FOLD + """, c AS (SELECT id, observer, state, CASE WHEN id % 4 > 0 THEN p END AS p, coalesce(outcome, false) AS truth, observer IN ('click', 'view') AND state NOT IN ('s0', 's1') AS ill FROM folded)
SELECT id, CASE WHEN ill THEN 'ill_posed' WHEN truth THEN 'satisfied' ELSE 'unverified' END AS verdict, truth AND NOT ill AS outcome, coalesce(p, CASE WHEN NOT ill AND truth THEN 0.9 ELSE 0.5 END) AS p FROM c""")
def ill_posed(spark: SparkSession, sf: str) -> DataFrame:
    obs = ledger.folded(fx.ledger(spark, sf)).withColumn("truth", F.coalesce("outcome", F.lit(False))).withColumn("p", F.when(F.col("id") % 4 > 0, F.col("p")))
    allowed = spark.createDataFrame([(o, s) for o in ("click", "view") for s in ("s0", "s1")], "observer string, state string")
    return ledger.claims(obs, allowed).select("id", "verdict", "outcome", "p")


@query("d30_worst_state", "SELECT user_id, arg_min(CASE WHEN event_type IN ('error', 'purchase', 'view', 'signup') THEN event_type ELSE 'unknown' END, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 2 END) AS state FROM events GROUP BY 1")
def worst_state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.upper("event_type").alias("state"))
    return ledger.worst_state(e, "user_id", ["error", "purchase", "unknown", "view", "signup"])


@query("d31_transitions", """WITH s AS (SELECT event_id, user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, state FROM s WHERE before IS NOT NULL AND before <> state AND (before, state) NOT IN (('view', 'click'), ('click', 'purchase'), ('view', 'signup'), ('signup', 'view'))""")
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("state"))
    legal = [("view", "click"), ("click", "purchase"), ("view", "signup"), ("signup", "view")]
    return ledger.illegal_transitions(e, legal, "user_id", ["ts", "event_id"]).select("event_id", "before", "state")


@query("d32_upkeep", """SELECT o_orderkey, CASE WHEN o_orderpriority[1:1] = '5' THEN 'not_upkeep' WHEN o_orderstatus <> 'F' OR o_totalprice >= 200000 THEN 'off_nominal' ELSE 'nominal' END AS verdict,
concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'finished' END, CASE WHEN o_totalprice >= 200000 THEN 'small' END) AS "off" FROM orders""")
def upkeep(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("is_upkeep", ~F.col("o_orderpriority").startswith("5"))
    out = ledger.upkeep(o, {"finished": F.col("o_orderstatus") == "F", "small": F.col("o_totalprice") < 200_000})
    return out.select("o_orderkey", "verdict", F.array_join("off", ",").alias("off"))
