"""Rules over ledgers, queues, catalogues and names; generated columns; tables of commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import keys, names
from varve.operators import claims, evidence, facts, generators, labels, ledger, profile
from varve.plans import fixtures as fx
from varve.plans.columns import P, _profile
from varve.plans.governance import _BUDGET, _requests
from varve.plans.history import FOLD
from varve.registry import query
from varve.session import shared_dir, table
from varve.sources import files
from varve.sources.commits import Commits


@query("d31_dwells", """WITH b AS (SELECT user_id, event_id, event_type AS state, epoch_us(ts) AS us, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS began FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(began) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b), s AS (SELECT user_id, island, any_value(state) AS state, min(us) AS since, count(*) AS steps FROM i GROUP BY ALL),
n AS (SELECT *, lead(since) OVER (PARTITION BY user_id ORDER BY island) AS until, CASE state WHEN 'view' THEN 'holding' WHEN 'purchase' THEN 'terminal' WHEN 'error' THEN 'terminal' ELSE 'passing' END AS kind, lead(island) OVER (PARTITION BY user_id ORDER BY island) IS NULL AS last FROM s)
SELECT user_id, state, since, until, steps, kind, CASE WHEN kind = 'terminal' AND NOT last THEN 'left a terminal state' WHEN kind = 'holding' AND last THEN 'held, not done' END AS problem FROM n""")
def dwells(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("state"), keys.micros("ts").alias("us"))
    return ledger.dwells(e, "user_id", "us", ["ts", "event_id"], ["view"], ["purchase", "error"])


_ENTRIES = "k AS (SELECT event_id % 199 AS item, user_id % 10 AS slot, epoch_us(ts) AS us, event_type IN ('purchase', 'signup') AS ok FROM events)"


@query("d38_backlog", f"""WITH {_ENTRIES}, l AS (SELECT item, arg_max(slot, (us, slot)) AS slot, max(us) AS us, max((us, slot)) FILTER (ok) AS lastok FROM k GROUP BY 1),
m AS (SELECT k.item, max(k.slot) AS deepest FROM k JOIN l USING (item) WHERE NOT ok AND (lastok IS NULL OR (k.us, k.slot) > lastok) GROUP BY 1)
SELECT item, l.slot, l.us AS "at", deepest, CASE WHEN deepest >= 9 THEN 'discussion' WHEN deepest >= 6 THEN 'briefing' WHEN deepest >= 5 THEN 'reminder' WHEN deepest >= 3 THEN 'agenda' WHEN deepest >= 1 THEN 'log' ELSE 'none' END AS channel, deepest IS NOT NULL AS open FROM l LEFT JOIN m USING (item)""")
def backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Events as entries of a backlog: purchases and signups resolve an item, others are misses of a slot."""
    e = table(spark, sf, "events").select((F.col("event_id") % 199).alias("item"), (F.col("user_id") % 10).alias("slot"), keys.micros("ts").alias("at"), F.col("event_type").isin("purchase", "signup").alias("ok"))
    return ledger.backlog(e)


_ALLOWED = [(o, s) for o in ("click", "view", "error", "nobody") for s in ("s0", "s1", "s9")]


@query("d26_forecasts", FOLD + f""", a(observer, state) AS (VALUES {', '.join(map(str, _ALLOWED))}), b AS (SELECT observer, state, count(*) AS n, count(outcome) AS resolved, round(avg((p - outcome::INT) * (p - outcome::INT))::DECIMAL(18, 10), 4)::DOUBLE AS brier FROM folded GROUP BY ALL),
f AS (SELECT state, observer, coalesce(n, 0) AS n, coalesce(resolved, 0) AS resolved, brier FROM a LEFT JOIN b USING (observer, state))
SELECT *, round((CASE WHEN brier IS NULL THEN 0.5 ELSE resolved / (resolved + 2.0) * (1 - brier) + 1.0 / (resolved + 2.0) END)::DECIMAL(18, 10), 4)::DOUBLE AS alpha, coalesce(brier, 0.5) AS risk FROM f""")
def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    allowed = spark.createDataFrame(_ALLOWED, "observer string, state string")
    return ledger.method_forecasts(ledger.folded(fx.ledger(spark, sf)), allowed)


@query("d34_capacity", f"""WITH {_BUDGET}, o AS (SELECT string_agg(node || ': children guaranteed ' || guaranteed || ' > max 30', '; ' ORDER BY node) AS parents FROM b WHERE guaranteed > 30 AND node NOT IN (SELECT queue FROM leaves)),
t AS (SELECT sum(greatest(coalesce(guaranteed, 0), coalesce(floor, 0)))::BIGINT AS total FROM leaves)
SELECT total, nullif(concat_ws('; ', parents, CASE WHEN total > 50 THEN 'leaf guaranteed ' || total || ' > capacity 50' END), '') AS reason FROM o, t""")
def capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the guarantees of all queues fit their parents and what there is."""
    r = _requests(spark, sf)
    leaves = r.groupBy("queue").agg(F.max("guaranteed").alias("guaranteed")).join(claims.floors(claims.live(r, 60)), "queue", "left")
    limits = claims.budgets(leaves).select("node", F.lit(30).cast("long").alias("max"))
    return claims.capacity_gate(leaves, limits, 50)


@query("e6_terminal_pruned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1996-01-01')")
def terminal_pruned(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", keys.micros("o_orderdate").alias("at"))
    return claims.pruned(o, 820_454_400_000_000, ("F", "P"), "o_orderstatus").select("o_orderkey", "o_orderstatus")


_CATALOGUE = """o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'w' || o_orderkey END AS id, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderpriority END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN '0 * * * *' ELSE '' END AS cron,
CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['w1'] WHEN 2 THEN ['w1', 'gone'] ELSE [] END AS after, CASE o_orderkey % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'some' ELSE '' END AS mode,
[('q' || (o_custkey % 6), o_orderkey % 9 - 1), ('q' || (o_custkey % 6), 2), (CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'q0' END, 1)] AS c, o_orderkey % 2 = 0 AS enabled FROM orders)"""


@query("c21_entry_rules", f"""WITH {_CATALOGUE}, x AS (SELECT k, trim(e[1]) AS leaf, e[2] AS n FROM (SELECT k, unnest(c) AS e FROM o)), s AS (SELECT k, leaf, sum(n)::BIGINT AS n FROM x WHERE leaf <> '' GROUP BY ALL), lim AS (SELECT 'q' || range AS leaf, 4 + range AS max FROM range(5)),
p AS (SELECT k, '01 id is required' AS problem FROM o WHERE id = '' UNION ALL SELECT k, '02 kind is required' FROM o WHERE kind IS NULL UNION ALL SELECT k, '06 unknown after_mode some' FROM o WHERE mode = 'some' UNION ALL SELECT k, '07 after_mode without after' FROM o WHERE mode <> '' AND len(after) = 0
UNION ALL SELECT k, '08 both cron and after without after_mode' FROM o WHERE cron <> '' AND len(after) > 0 AND mode = '' UNION ALL SELECT k, '03 claim without a leaf' FROM x WHERE leaf = '' UNION ALL SELECT k, '03 claim ' || leaf || ': negative' FROM x WHERE leaf <> '' AND n < 0
UNION ALL SELECT k, CASE WHEN max IS NULL THEN '04 claim on unknown leaf ' || leaf ELSE '04 claim ' || n || ' on ' || leaf || ' exceeds ' || max END FROM s LEFT JOIN lim USING (leaf) WHERE max IS NULL OR n > max
UNION ALL SELECT k, '05 no such predecessor ' || a FROM (SELECT k, unnest(after) AS a FROM o) WHERE a NOT IN (SELECT id FROM o)), f AS (SELECT k, string_agg(DISTINCT problem, '; ' ORDER BY problem) AS found FROM p GROUP BY 1)
SELECT id, CASE WHEN found IS NOT NULL THEN 'error' WHEN enabled THEN 'materialized' ELSE 'paused' END AS state, coalesce(regexp_replace(found, '(^|; )[0-9][0-9] ', '\\1', 'g'), '') AS problems FROM o LEFT JOIN f USING (k)""")
def entry_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as catalogue entries that break rules of every kind."""
    k = F.col("o_orderkey")
    leaf = F.concat(F.lit("q"), F.col("o_custkey") % 6)
    claim = lambda leaf, n: F.struct(leaf.alias("leaf"), n.cast("long").alias("n"))
    o = table(spark, sf, "orders").select(
        F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("w"), k)).alias("id"), F.when(k % 37 != 0, F.col("o_orderpriority")).alias("kind"), F.when(k % 3 == 0, "0 * * * *").otherwise("").alias("cron"),
        F.when(k % 4 == 1, F.array(F.lit("w1"))).when(k % 4 == 2, F.array(F.lit("w1"), F.lit("gone"))).otherwise(F.array().cast("array<string>")).alias("after"), F.when(k % 5 == 0, "all").when(k % 5 == 1, "some").otherwise("").alias("after_mode"),
        F.array(claim(leaf, k % 9 - 1), claim(leaf, F.lit(2)), claim(F.when(k % 13 == 0, " ").otherwise("q0"), F.lit(1))).alias("claims"), (k % 2 == 0).alias("enabled"),
    )
    limits = spark.range(5).select(F.concat(F.lit("q"), "id").alias("leaf"), (F.col("id") + 4).alias("max"))
    return claims.entry_rules(o, limits)


@query("d21_converged", "SELECT *, coverage >= 0.95 AND coalesce(mean_conflict, 0) < 0.2 AS converged FROM (SELECT o_custkey % 7 AS pass, round(avg((o_orderkey % (o_custkey % 7 + 2) <> 0)::INT), 4) AS coverage, round(avg(o_orderkey % 10 / 40.0), 4) AS mean_conflict FROM orders GROUP BY 1)")
def converged(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("pass", F.col("o_custkey") % 7)
    figures = o.groupBy("pass").agg(F.round(F.avg((F.col("o_orderkey") % (F.col("pass") + 2) != 0).cast("int")), 4).alias("coverage"), F.round(F.avg(F.col("o_orderkey") % 10 / 40.0), 4).alias("mean_conflict"))
    return labels.converged(figures)


_KIND_NAMES = "n AS (SELECT p_partkey AS item, CASE p_partkey % 5 WHEN 0 THEN 'row_id' WHEN 1 THEN 'attr_' || p_size WHEN 2 THEN 'ref__' || p_size WHEN 3 THEN 'col_' || p_size || '_' || p_partkey ELSE 'xcol_' || p_size END AS name FROM part)"


@query("b09_kinds", f"WITH {_KIND_NAMES} SELECT item, name, CASE WHEN name = 'row_id' THEN 'row_id' WHEN item % 5 IN (1, 3) THEN 'annotation' ELSE 'data' END AS kind FROM n")
def kinds(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 5 == 0, "row_id").when(k % 5 == 1, F.concat(F.lit("attr_"), size)).when(k % 5 == 2, F.concat(F.lit("ref__"), size)).when(k % 5 == 3, F.concat_ws("_", F.lit("col"), size, k.cast("string"))).otherwise(F.concat(F.lit("xcol_"), size))
    return table(spark, sf, "part").select(k.alias("item"), name.alias("name")).withColumn("kind", names.kind("name"))


_ENGINE = {"int64": "INT", "decimal128(10, 2)": "FLOAT", "large_string": "STRING", "bool_": "BOOL", "timestamp[us, tz=UTC]": "TIMESTAMP", "list<item: blob>": "STRING", "DOUBLE": "FLOAT", " uint8 ": "INT", "date32[day]": "TIMESTAMP"}


@query("b11_engine_types", f"WITH t(place, type, simple) AS (VALUES {', '.join(str((i, a, b)) for i, (a, b) in enumerate(_ENGINE.items()))}) SELECT p_partkey, type, simple FROM part JOIN t ON place = p_partkey % {len(_ENGINE)}")
def engine_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types as engines name them, one for each part."""
    kind = F.element_at(F.array(*map(F.lit, _ENGINE)), (F.col("p_partkey") % len(_ENGINE) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", kind.alias("type")).withColumn("simple", names.engine_type("type"))


_TYPES = "t AS (SELECT source_table, column_name, CASE WHEN numeric_ratio > 0.8 THEN 'INT' ELSE 'VARCHAR' END AS type FROM described)"


@query("b14_typed_text", P + f", {_TYPES} SELECT source_table, column_name, concat_ws(' | ', replace(column_name, '_', ' '), CASE WHEN type <> 'VARCHAR' THEN lower(type) END, CASE WHEN len(sample) > 0 THEN array_to_string([v[1:80] FOR v IN sample[1:5]], ', ') END) AS text FROM described JOIN t USING (source_table, column_name)")
def typed_text(spark: SparkSession, sf: str) -> DataFrame:
    d = _profile(spark, sf).withColumn("type", F.when(F.col("numeric_ratio") > 0.8, "INT").otherwise("VARCHAR"))
    return d.select(*profile.KEY, profile.short_text("column_name", "type", "sample").alias("text"))


@query("b13_typed_text", P + f", {_TYPES} SELECT source_table, column_name, concat_ws(' | ', replace(column_name, '_', ' '), type, 'cardinality=' || cardinality) AS text FROM described JOIN t USING (source_table, column_name)")
def typed_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    """Name, type and cardinality: the other features are switched off."""
    d = _profile(spark, sf).withColumn("type", F.when(F.col("numeric_ratio") > 0.8, "INT").otherwise("VARCHAR"))
    off = tuple(f for f in profile.FEATURES if f not in ("column_name", "column_type", "cardinality"))
    return d.select(*profile.KEY, profile.embedding_text(off, "type").alias("text"))


@query("b21_backwards", """WITH s AS (SELECT c_custkey AS item, min(o_orderdate)::DATE AS a, min(o_orderdate)::DATE + (c_custkey % 9)::INT AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT item, (len - i)::INT AS place, day, isoyear(day) || '-W' || lpad(week(day)::VARCHAR, 2, '0') AS week FROM (SELECT item, unnest(range(0, (b - a) + 1)) AS i, a + unnest(range(0, (b - a) + 1))::INT AS day, b - a AS len FROM s)""")
def backwards(spark: SparkSession, sf: str) -> DataFrame:
    """The days after each customer's first order, last first; half of the spans have their ends swapped."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.to_date(F.min("o_orderdate")).alias("a"))
    b = F.date_add("a", (F.col("item") % 9).cast("int"))
    swap = F.col("item") % 2 == 0
    spans = o.select("item", F.when(swap, b).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(b).alias("y"))
    return keys.day_windows(spans, "x", "y", backwards=True, keep=["item"])


@query("b06_definitions", """SELECT 'def.' || p_brand || '.title' AS a, max(p_type) AS v FROM part GROUP BY p_brand UNION ALL SELECT 'def.' || p_brand || '.intent', max(p_name) FROM part WHERE p_size % 2 = 0 GROUP BY p_brand
UNION ALL SELECT DISTINCT 'spec.s' || s_nationkey || '.requires.' || x, 'true' FROM (SELECT s_nationkey, unnest(['size', 'n' || (s_suppkey % 3)]) AS x FROM supplier)""")
def definitions(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("intent"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("id"), F.array(F.lit("size"), F.concat(F.lit("n"), F.col("s_suppkey") % 3)).alias("requires"))
    return facts.definition_facts(a, s)


# --- generated columns

_K = "([" + ", ".join(f"'{k}'" for k in generators.KINDS) + "])"
_LIST = lambda words: "([" + ", ".join(f"'{w}'" for w in words) + "])"
_HEX = lambda i, n=4: f"('0x' || h[{i + 1}:{i + n}])::BIGINT"
_DIG = lambda i, w, n: f"lpad(({_HEX(i, w)} % {10**n})::VARCHAR, {n}, '0')"
_VALUES = {
    "card": f"body || ((10 - (SELECT sum(CASE WHEN d > 9 THEN d - 9 ELSE d END) FROM (SELECT unnest([CASE WHEN i % 2 = 0 THEN 2 * reverse(body)[i + 1]::INT ELSE reverse(body)[i + 1]::INT END FOR i IN range(0, 15)]) AS d)) % 10) % 10)::BIGINT::VARCHAR",
    "iban": "'DE' || lpad((98 - (account || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || account", "date": f"strftime(DATE '1950-01-01' + ({_HEX(0)} % 27000)::INT, '%Y-%m-%d')", "email": "h[1:8] || '@example.org'",
    "phone": f"'+49 ' || {_DIG(0, 4, 3)} || ' ' || {_DIG(4, 7, 7)}",
    "address": f"({_HEX(0)} % 999 + 1)::VARCHAR || ' ' || {_LIST(generators.STREETS)}[{_HEX(4)} % 8 + 1] || ' Street, ' || {_LIST(generators.CITIES)}[{_HEX(8)} % 8 + 1] || ' ' || {_DIG(12, 5, 5)}",
    "ipv4": " || '.' || ".join(f"({_HEX(i, 2)})::VARCHAR" for i in (0, 2, 4, 6)), "uuid": "h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]", "url": "'https://example.org/' || h[1:10]",
    "ssn": f"{_DIG(0, 4, 3)} || '-' || {_DIG(4, 4, 2)} || '-' || {_DIG(8, 4, 4)}", "amount": f"({_HEX(0)} % 9000)::VARCHAR || '.' || {_DIG(4, 4, 2)}", "mac": " || ':' || ".join(f"h[{i}:{i + 1}]" for i in (1, 3, 5, 7, 9, 11)),
}
_GENERATED = f"""c AS (SELECT DISTINCT p_brand || p_type AS code, {_K}[p_size % 12 + 1] AS kind FROM part), b AS (SELECT code, kind, unnest(range(0, 6)) AS variant FROM c), s AS (SELECT *, md5(code || '/' || variant) AS seed FROM b),
w AS (SELECT *, replace(({", ".join(str(list(x)) for x in generators.SYNONYMS.values()).join(["[", "]"])})[list_position({_K}, kind)][('0x' || seed[1:4])::BIGINT % 3 + 1], ' ', '_') AS word FROM s),
nm AS (SELECT *, variant % 2 = 1 AS opaque, CASE WHEN variant % 2 = 1 THEN 'c' || seed[1:6] ELSE CASE variant % 6 WHEN 0 THEN word WHEN 2 THEN upper(word) ELSE 'src_' || word END || '_' || variant END AS column_name, unnest(range(0, 20)) AS row FROM w),
hh AS (SELECT *, md5(seed || '/' || row) AS h FROM nm), bb AS (SELECT *, '4' || {_DIG(0, 7, 7)} || {_DIG(7, 7, 7)} AS body, {_DIG(0, 8, 9)} || {_DIG(8, 8, 9)} AS account FROM hh),
made AS (SELECT code, kind, column_name, opaque, row, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _VALUES.items())} END AS value FROM bb)"""


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, generators.KINDS)), (F.col("p_size") % 12 + 1).cast("int"))
    return generators.labelled_columns(table(spark, sf, "part").select(F.concat("p_brand", "p_type").alias("code"), kind.alias("kind")).distinct(), 6, 20)


@query("m6_generated", f"WITH {_GENERATED} SELECT * FROM made")
def generated(spark: SparkSession, sf: str) -> DataFrame:
    return _generated(spark, sf)


_SEEN = {"date": "date_iso_pattern", "email": "email_pattern", "ipv4": "ipv4_pattern", "uuid": "uuid_pattern", "url": "url_pattern", "ssn": "ssn_pattern", "phone": "phone_pattern", "card": "credit_card_pattern"}


@query("m6_recognised", f"""WITH {_GENERATED} SELECT kind, count(*) AS n, {", ".join(f"count(*) FILTER (regexp_matches(value, '{names.PATTERNS[p]}')) AS {k}" for k, p in _SEEN.items())}, count(*) FILTER (kind IN ('card', 'iban')) AS checked FROM made GROUP BY 1""")
def recognised(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each kind the patterns find, and how many card and account numbers pass their check."""
    g = _generated(spark, sf)
    v = F.col("value")
    card = (F.col("kind") == "card") & (generators.luhn_digit(F.substring(v, 1, 15)) == F.substring(v, 16, 1))
    # an account is right if the number with its check digits leaves 1
    iban = (F.col("kind") == "iban") & (F.concat(F.substring(v, 5, 18), F.lit("1314"), F.substring(v, 3, 2)).try_cast("decimal(38,0)") % 97 == 1)
    return g.groupBy("kind").agg(F.count("*").alias("n"), *(F.count_if(v.rlike(names.PATTERNS[p])).alias(k) for k, p in _SEEN.items()), F.count_if(F.coalesce(card | iban, F.lit(False))).alias("checked"))


# --- tables of commits, packages, landing


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/varve-rules-{uuid.uuid4().hex}"


@query("a13_appends", "SELECT o_orderkey AS tx, o_custkey AS e, o_orderstatus AS v FROM orders")
def appends(spark: SparkSession, sf: str) -> DataFrame:
    """Facts appended in four transactions, one of them twice, and compacted in between."""
    log = Commits(spark, _folder(spark))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("e"), F.col("o_orderstatus").alias("v"))
    for txn in (0, 1, 1, 2, 3):
        log.append(o.where(F.col("tx") % 4 == txn), "facts", txn)
        if txn == 2:
            log.compact(0)
    return log.read()


@query("a06_package_status", "SELECT 3::BIGINT AS version, 'logical-parquet/1' AS formats, 2::BIGINT AS services, 2::BIGINT AS tables, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS rows")
def package_status(spark: SparkSession, sf: str) -> DataFrame:
    """A new package, a file taken in with its delimiter, and what it says of itself."""
    folder = _folder(spark)
    p = files.Package(spark, folder)
    p.init()
    p.init()
    table(spark, sf, "nation").coalesce(1).write.csv(f"{folder}-in/nation.csv", header=True, sep=";")
    p.ingest_file(f"{folder}-in/nation.csv", "geo", delimiter=";")
    p.ingest(table(spark, sf, "region"), "base", "region")
    return p.status().join(p.manifest().agg(F.sum("rows").alias("rows")))


@query("a04_landing_files", "SELECT 'supplier' AS source_table, count(*) AS n FROM (SELECT * FROM supplier LIMIT 7) UNION ALL SELECT 'nation', count(*) FROM (SELECT * FROM nation LIMIT 7)")
def landing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Of a folder the files that are to be landed, each up to a number of rows (a parameter of the landing)."""
    folder, out = _folder(spark), None
    for name in ("supplier_data.csv", "nation_data.csv", "annotations.csv", "other.csv"):
        table(spark, sf, name.split("_")[0] if "_" in name else "region").write.csv(f"{folder}/{name}", header=True)
    for path in files.landing_files(spark, folder):
        rows = files.land_csv(spark, path, max_rows=7).agg(F.lit(files.stem(path).removesuffix("_data")).alias("source_table"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


_GIVEN = {
    "source_table": "'t' || o_custkey", "column_name": "'c' || o_orderkey", "tag_code": "o_orderpriority", "confidence": "o_orderkey % 10 / 10.0", "belief": "o_orderkey % 4 / 8.0", "plausibility": "0.5", "uncertainty_gap": "0.5 - o_orderkey % 4 / 8.0",
    "conflict": "o_orderkey % 5 / 10.0", "needs_clarification": "o_orderkey % 3 = 0", "feat_cardinality": "(o_custkey % 7)::VARCHAR", "sage_null_ratio": "0.25", "sage_cardinality": "-0.5", "shap_top1_name": "'g' || (o_orderkey % 2)", "shap_top1_value": "o_orderkey % 6 / 2.0",
    "shap_top3_name": "CASE WHEN o_orderkey % 2 = 0 THEN 'rest' ELSE '' END", "shap_top3_value": "CASE WHEN o_orderkey % 2 = 0 THEN 0.125 ELSE 0.0 END",
}
_DEFAULTS = {"string": "''", "double": "0.0", "boolean": "false"}
_CLASSIFIED = ", ".join(f"({_GIVEN.get(c, _DEFAULTS[kind])}) AS {c}" for c, kind in files.classified_schema(profile.FEATURES).items())


def _results(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").withColumn("source_table", F.concat(F.lit("t"), "o_custkey")).withColumn("column_name", F.concat(F.lit("c"), k))
    rows = o.select(
        "source_table", "column_name", F.col("o_orderpriority").alias("tag_code"), (k % 10 / 10.0).alias("confidence"), (k % 4 / 8.0).alias("belief"), F.lit(0.5).alias("plausibility"), (0.5 - k % 4 / 8.0).alias("uncertainty_gap"),
        (k % 5 / 10.0).alias("conflict"), (k % 3 == 0).alias("needs_clarification"), (F.col("o_custkey") % 7).alias("feat_cardinality"),
    )
    first = o.select("source_table", "column_name", F.lit(1).alias("place"), F.concat(F.lit("g"), k % 2).alias("name"), (k % 6 / 2.0).alias("value"))
    third = o.where(k % 2 == 0).select("source_table", "column_name", F.lit(3).alias("place"), F.lit("rest").alias("name"), F.lit(0.125).alias("value"))
    sage = spark.createDataFrame([("null_ratio", 0.25), ("cardinality", -0.5)], "feature string, value double")
    return files.write_results(rows, sage, first.unionByName(third), _folder(spark), profile.FEATURES)


@query("a14_classified", f"SELECT {_CLASSIFIED} FROM orders")
def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as classified columns under the whole fixed schema, written and read again."""
    return _results(spark, sf)


@query("a14_uncertainty", f"WITH c AS (SELECT {_CLASSIFIED} FROM orders) SELECT round(avg(uncertainty_gap) FILTER (belief > 0), 4) AS avg_uncertainty_gap, round(avg(conflict) FILTER (belief > 0), 4) AS avg_conflict, count(*) FILTER (needs_clarification) AS clarification_count, count(*) FILTER (belief > 0) AS columns_evaluated FROM c")
def uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    return files.uncertainty_summary(_results(spark, sf))


@query("d19_by_kind", """WITH j AS (SELECT o_orderkey AS item, CASE o_orderkey % 3 WHEN 0 THEN 'annotation' ELSE 'data' END AS kind, o_custkey % 5 AS code, o_orderkey % 5 AS truth, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 ELSE o_custkey % 3 END AS boosted, o_custkey % 2 AS without FROM orders)
SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg((code = truth)::INT), 4) AS accuracy, count(*) FILTER (code = truth AND boosted = truth) AS assisted, count(*) FILTER (code = truth AND boosted = truth AND without <> truth) AS dependent FROM j GROUP BY ROLLUP (kind)""")
def by_kind(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(F.when(k % 3 == 0, "annotation").otherwise("data").alias("kind"), (c % 5).alias("code"), (k % 5).alias("truth"), F.when(k % 4 == 0, k % 5).otherwise(c % 3).alias("boosted"), (c % 2).alias("without"))
    return evidence.by_kind(rows)
