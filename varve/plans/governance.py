"""Graphs, tags, claims and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import claims, graph
from varve.registry import query
from varve.session import table


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """region -> nation -> customer -> order, as one table."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("has").alias("label"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("home").alias("label"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("placed").alias("label"))
    return n.unionByName(c).unionByName(o)


_EDGES = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'has' AS label FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'home' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'placed' FROM orders)"
_BFS = f"{_EDGES}, walk AS (SELECT 'r1' AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM walk JOIN edges ON src = node WHERE hop < 3), reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY 1)"


@query("c19_frontier", f"WITH RECURSIVE {_BFS} SELECT node, hop FROM reached")
def frontier(spark: SparkSession, sf: str) -> DataFrame:
    return graph.frontier(edges(spark, sf), spark.createDataFrame([("r1",)], "node string"), 3)


@query("c19_frontier_reverse", f"WITH RECURSIVE {_EDGES}, walk AS (SELECT 'o' || min(o_orderkey) AS node, 0 AS hop FROM orders UNION SELECT src, hop + 1 FROM walk JOIN edges ON dst = node WHERE hop < 3) SELECT node, min(hop) AS hop FROM walk GROUP BY 1")
def frontier_reverse(spark: SparkSession, sf: str) -> DataFrame:
    start = table(spark, sf, "orders").agg(F.concat(F.lit("o"), F.min("o_orderkey")).alias("node"))
    return graph.frontier(edges(spark, sf), start, 3, reverse=True)


@query("c19_hop_rows", f"WITH RECURSIVE {_BFS} SELECT hop, count(*) AS edges, count(DISTINCT dst) AS targets FROM edges JOIN reached ON src = node GROUP BY 1")
def hop_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.hop_rows(e, graph.frontier(e, spark.createDataFrame([("r1",)], "node string"), 3))


def _memberships(spark: SparkSession, sf: str) -> DataFrame:
    """(resource, tag): a part has the tags of its brand and its type."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("resource"), F.explode(F.array("p_brand", "p_type")).alias("tag"))


_MEMBERS = "WITH m AS (SELECT p_partkey AS resource, unnest([p_brand, p_type]) AS tag FROM part) "


@query("c20_tags", _MEMBERS + "SELECT tag, count(*) AS n, string_agg(resource::VARCHAR, ',' ORDER BY resource) AS resources FROM m GROUP BY 1")
def tags(spark: SparkSession, sf: str) -> DataFrame:
    """One membership table read by tag."""
    return graph.members(_memberships(spark, sf), "tag", "resource", "resources")


@query("c20_resources", _MEMBERS + "SELECT resource, count(*) AS n, string_agg(tag, ',' ORDER BY tag) AS tags FROM m GROUP BY 1")
def resources(spark: SparkSession, sf: str) -> DataFrame:
    """The same table read by resource."""
    return graph.members(_memberships(spark, sf), "resource", "tag", "tags")


@query("c20_policies", "SELECT p_partkey AS resource, min(policy) AS policy FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS tag FROM part) JOIN (VALUES ('ECONOMY', 'p2'), ('Brand#11', 'p1'), ('Brand#23', 'p3')) t(tag, policy) USING (tag) GROUP BY 1")
def policies(spark: SparkSession, sf: str) -> DataFrame:
    """The first policy of each resource by its tags."""
    index = spark.createDataFrame([("ECONOMY", "p2"), ("Brand#11", "p1"), ("Brand#23", "p3")], "tag string, policy string")
    return _memberships(spark, sf).join(index, "tag").groupBy("resource").agg(F.min("policy").alias("policy"))


@query("t7_edges", "SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS other, 'out' AS side FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'in' FROM nation")
def edges_both_sides(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return graph.both_sides(n)


@query("t7_tags", """WITH e AS (SELECT o_custkey AS resource, o_orderpriority AS tag, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS events FROM orders GROUP BY ALL) SELECT resource, tag, events FROM e WHERE status <> 'F'""")
def tag_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders assign their priority to the customer as a tag, finished ones remove it; the audit keeps every event."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("resource"), F.col("o_orderpriority").alias("tag"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("assign").alias("op"))
    held, audit = graph.apply_tags(o, "seq")
    return held.join(audit.groupBy("resource", "tag").agg(F.count("*").alias("events")), ["resource", "tag"])


@query("t7_projection", "SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) <> 'F'")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as changes of their customer; a finished one deletes."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("op"))
    return graph.apply_changes(o, "key", "seq").select("key", "o_orderkey")


@query("t7_rename", "SELECT l_orderkey * 10 + l_linenumber AS seq, k AS key, op FROM (SELECT l_orderkey, l_linenumber, unnest(['p' || l_partkey, 's' || l_suppkey]) AS k, unnest(['delete', 'upsert']) AS op FROM lineitem)")
def rename(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("p"), "l_partkey").alias("old"), F.concat(F.lit("s"), "l_suppkey").alias("new"))
    return graph.renames(e, "old", "new")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.concat(F.lit("root.n"), F.expr("o_custkey % 7"), F.lit(".q"), F.expr("o_custkey % 3")).alias("queue"), F.when(k % 3 == 0, k % 11).alias("floor"), F.when(k % 2 == 0, k % 13).alias("footprint"),
        (k % 5).alias("guaranteed"), (k % 100).alias("valid_from"), (k % 100 + 50).alias("valid_until"), F.when(k % 4 == 0, "rejected").otherwise("accepted").alias("state"), F.col("o_custkey"),
    )


_REQ = """req AS (SELECT o_orderkey AS id, 'root.n' || (o_custkey % 7) || '.q' || (o_custkey % 3) AS queue, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 11 END AS floor, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 13 END AS footprint,
o_orderkey % 5 AS guaranteed, o_orderkey % 100 AS valid_from, o_orderkey % 100 + 50 AS valid_until, CASE WHEN o_orderkey % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS state, o_custkey FROM orders),
live AS (SELECT * FROM req WHERE valid_from <= 60 AND valid_until > 60 AND state = 'accepted'), floors AS (SELECT queue, max(coalesce(floor, footprint, guaranteed)) AS floor FROM live GROUP BY 1)"""
_BUDGET = _REQ + """, leaves AS (SELECT r.queue, max(guaranteed) AS guaranteed, any_value(f.floor) AS floor FROM req r LEFT JOIN floors f USING (queue) GROUP BY 1),
b AS (SELECT node, sum(g)::BIGINT AS guaranteed, count(*) AS leaves FROM (SELECT unnest([split_part(queue, '.', 1), split_part(queue, '.', 1) || '.' || split_part(queue, '.', 2), queue]) AS node, greatest(coalesce(guaranteed, 0), coalesce(floor, 0)) AS g FROM leaves) GROUP BY 1)"""


def _budget(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    f = claims.floors(claims.live(r, 60))
    return claims.budgets(r.groupBy("queue").agg(F.max("guaranteed").alias("guaranteed")).join(f, "queue", "left"))


@query("d33_floors", f"WITH {_REQ} SELECT * FROM floors")
def floors(spark: SparkSession, sf: str) -> DataFrame:
    return claims.floors(claims.live(_requests(spark, sf), 60))


@query("d34_budgets", f"WITH {_BUDGET} SELECT * FROM b")
def budgets(spark: SparkSession, sf: str) -> DataFrame:
    return _budget(spark, sf)


@query("d34_violations", f"WITH {_BUDGET} SELECT node, guaranteed, 30::BIGINT AS max, node || ': guaranteed ' || guaranteed || ' exceeds 30' AS problem FROM b WHERE guaranteed > 30")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    b = _budget(spark, sf)
    return claims.over_budget(b, b.select("node", F.lit(30).cast("long").alias("max")))


@query("c23_over_commit", """WITH held AS (SELECT s_nationkey AS leaf, sum(s_suppkey % 4) AS held FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1), wanted AS (SELECT s_nationkey AS leaf, sum(s_suppkey % 5) AS wanted FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1),
lim AS (SELECT n_nationkey AS leaf, 4 + n_nationkey % 5 AS max FROM nation WHERE n_nationkey % 6 <> 0)
SELECT leaf, coalesce(held, 0)::BIGINT AS held, wanted::BIGINT AS wanted, max, CASE WHEN max IS NULL THEN 'unknown' WHEN coalesce(held, 0) + wanted > max THEN 'refused' ELSE 'fine' END AS verdict FROM wanted LEFT JOIN held USING (leaf) LEFT JOIN lim USING (leaf)""")
def over_commit(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("leaf", F.col("s_nationkey"))
    lim = table(spark, sf, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("leaf"), F.expr("4 + n_nationkey % 5").alias("max"))
    return claims.over_commit(s.where("s_suppkey % 3 = 0").withColumn("n", F.col("s_suppkey") % 4), s.where("s_suppkey % 3 <> 0").withColumn("n", F.col("s_suppkey") % 5), lim)


@query("g3_lease_state", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'released' WHEN 1000 >= o_orderkey % 2000 OR 1000 - o_orderkey % 1500 >= 100 THEN 'lapsed' ELSE 'alive' END AS state FROM orders")
def lease_state(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("released"), (F.col("o_orderkey") % 2000).alias("horizon"), (F.col("o_orderkey") % 1500).alias("heartbeat"), F.lit(100).alias("ttl"))
    return claims.lease_state(o, 1000).select("o_orderkey", "state")


@query("e07_supersession", """WITH r AS (SELECT o_orderkey AS id, o_custkey AS peer, o_orderdate AS "at", unnest(['k' || (o_orderkey % 3), 'm' || (o_orderkey % 4)]) AS key, CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 1 END AS sup FROM orders),
s AS (SELECT id, bool_or(newer IS NOT NULL) AS shared FROM (SELECT id, lead(id) OVER (PARTITION BY peer, key ORDER BY "at", id) AS newer FROM r) GROUP BY 1) SELECT id, shared OR id IN (SELECT sup FROM r WHERE sup IS NOT NULL) AS retired FROM s""")
def supersession(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    keys = F.array(F.concat(F.lit("k"), F.expr("o_orderkey % 3")), F.concat(F.lit("m"), F.expr("o_orderkey % 4")))
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("peer"), F.col("o_orderdate").alias("at"), keys.alias("keys"), F.when(F.expr("o_orderkey % 50 = 7"), F.expr("o_orderkey - 1")).alias("supersedes"))
    return claims.superseded(r).select("id", "retired")


@query("e04_enabled_since", """WITH l AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS enabled FROM events), b AS (SELECT *, enabled AND NOT coalesce(lag(enabled) OVER w, false) AS begins FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN enabled THEN last_value(CASE WHEN begins THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS enabled_since FROM b""")
def enabled_since(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").isin("click", "view").alias("enabled"))
    return claims.enabled_since(log, "user_id", "event_id").select("event_id", "enabled_since")


@query("e06_retention", """WITH f AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), g AS (SELECT * FROM f WHERE before IS DISTINCT FROM event_type)
SELECT user_id, event_id, event_type FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5""")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return claims.retained(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 5, "event_type")


@query("e03_top_k", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("n", F.row_number().over(by)).where("n <= 3").select("l_partkey", "l_orderkey", "l_linenumber")


@query("e05_constant_step", """WITH s AS (SELECT l_partkey, l_orderkey - lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS step FROM lineitem)
SELECT l_partkey, count(*) AS n, count(*) >= 3 AND coalesce(max(step) - min(step) < 0.01, false) AS constant FROM s GROUP BY 1""")
def constant_step(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.col("l_orderkey") - F.lag("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    s = table(spark, sf, "lineitem").select("l_partkey", step.alias("step"))
    return s.groupBy("l_partkey").agg(F.count("*").alias("n"), ((F.count("*") >= 3) & F.coalesce(F.max("step") - F.min("step") < 0.01, F.lit(False))).alias("constant"))


@query("c21_catalogue", """WITH e AS (SELECT CASE WHEN p_partkey % 40 = 3 THEN p_partkey - 1 ELSE p_partkey END AS id, p_partkey + 5 AS after, p_brand AS leaf, p_size AS n FROM part), lim AS (SELECT p_brand AS leaf, 45 AS max FROM part GROUP BY 1),
p AS (SELECT id, 'unknown predecessor ' || after AS problem FROM e WHERE after NOT IN (SELECT id FROM e) UNION SELECT id, 'claims ' || s || ' of ' || leaf || ', limit ' || max FROM (SELECT id, leaf, sum(n) AS s FROM e GROUP BY ALL) JOIN lim USING (leaf) WHERE s > max UNION SELECT id, 'repeated id' FROM e GROUP BY id HAVING count(*) > 1)
SELECT id, string_agg(problem, '; ' ORDER BY problem) AS problems FROM p GROUP BY 1""")
def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    ident = F.when(F.col("p_partkey") % 40 == 3, F.col("p_partkey") - 1).otherwise(F.col("p_partkey"))
    e = p.select(ident.alias("id"), F.array(F.col("p_partkey") + 5).alias("after"), F.col("p_brand").alias("leaf"), F.col("p_size").alias("n"))
    lim = p.select(F.col("p_brand").alias("leaf")).distinct().withColumn("max", F.lit(45))
    return claims.catalogue_problems(e, lim)


@query("c22_snapshot_sync", "SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(b.p_size, a.p_size) AS p_size, CASE WHEN b.p_partkey IS NULL THEN 'paused' WHEN a.p_partkey IS NULL THEN 'new' ELSE 'kept' END AS state FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_partkey % 4 <> 0) b USING (p_partkey)")
def snapshot_sync(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return claims.snapshot_sync(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 4 <> 0").withColumn("p_size", F.col("p_size") + 1), "p_partkey", ["p_size"])


@query("c24_merge_hints", "SELECT n_nationkey AS leaf, n_nationkey % 4 AS max, NULL AS peer FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT s_nationkey, arg_min(s_suppkey % 4, s_name), min(s_name) FROM supplier WHERE s_nationkey % 2 = 1 GROUP BY 1")
def merge_hints(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("leaf"), (F.col("n_nationkey") % 4).cast("long").alias("max"))
    hints = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("leaf"), (F.col("s_suppkey") % 4).alias("max"), F.col("s_name").alias("peer"))
    return claims.merge_hints(own, hints, "leaf")
