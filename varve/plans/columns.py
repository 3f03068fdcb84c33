"""Column semantics: sampling, profiles, names, discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from varve.functions import names
from varve.operators import profile
from varve.registry import query
from varve.session import table

COLUMNS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "user_id", "event_type", "props", "ts", "value"],
    "documents": ["doc_id", "lang", "source", "n_chars", "text"],
    "pages": ["page_id", "url", "html"],
}
#: Prices have two digits, values four, and times are whole days or seconds, printed alike by both engines.
MONEY, VALUES, DAYS, TIMES = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("value",), ("o_orderdate", "l_shipdate"), ("ts",)
SAMPLE = 12


#: Columns of doubles and the decimals that they are printed as.
DECIMALS = {c: DecimalType(18, 2) for c in MONEY} | {c: DecimalType(18, 4) for c in VALUES}


def raw(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables; days and times are cut to what is printed."""
    return {t: table(spark, sf, t).select(*map(_printed, c)) for t, c in COLUMNS.items()}


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables, their columns in types that both engines print alike."""
    return {t: df.select(*(F.col(c).cast(DECIMALS[c]).alias(c) if c in DECIMALS else c for c in df.columns)) for t, df in raw(spark, sf).items()}


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (profile.cells(df, t) for t, df in tables(spark, sf).items()))


def _sample(spark: SparkSession, sf: str, n: int, how: str = "frequent", seed: str = "") -> DataFrame:
    return profile.sample_tables(tables(spark, sf), n, how, seed)


def _printed(c: str) -> Column:
    return F.col(c).cast("date").alias(c) if c in DAYS else F.date_trunc("second", c).alias(c) if c in TIMES else F.col(c)


def _printed_sql(c: str) -> str:
    kind = "DECIMAL(18, 2)" if c in MONEY else "DECIMAL(18, 4)" if c in VALUES else "DATE" if c in DAYS else "VARCHAR"
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in TIMES else f"{c}::{kind}::VARCHAR"


_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT '{t}' AS source_table, '{c}' AS column_name, {_printed_sql(c)} AS value FROM {t}" for t, cs in COLUMNS.items() for c in cs) + ")"
_COUNTS = "counts AS (SELECT source_table, column_name, value, count(*) AS n FROM cells WHERE value <> '' GROUP BY ALL)"
_SAMPLE = f"sampled AS (SELECT *, row_number() OVER (PARTITION BY source_table, column_name ORDER BY n DESC, value) AS place FROM counts QUALIFY place <= {SAMPLE})"
S = f"WITH {_CELLS}, {_COUNTS}, {_SAMPLE}"
_HITS = ", ".join(f"count(*) FILTER (regexp_matches(trim(value), '{p}')) AS h_{n}" for n, p in names.PATTERNS.items())
_STATS = f"""rows AS (SELECT *, length(value) AS len, CASE WHEN regexp_matches(trim(value), '{names.NUMBER}') THEN replace(trim(value), ',', '')::DOUBLE END AS num FROM sampled),
steps AS (SELECT *, num - lag(num) OVER (PARTITION BY source_table, column_name ORDER BY place) AS step FROM rows),
ent AS (SELECT source_table, column_name, round(0.0 - sum(p * log2(p)), 4) AS entropy FROM (SELECT source_table, column_name, len, count(*) / sum(count(*)) OVER (PARTITION BY source_table, column_name) AS p FROM rows GROUP BY source_table, column_name, len) GROUP BY ALL),
stats AS (SELECT source_table, column_name, count(*) AS "values", count(DISTINCT value) AS cardinality, round(avg(len), 2) AS avg_len, round(count(num) / count(*), 4) AS numeric_ratio,
  bool_or(contains(value, '.')) AS point, bool_and(coalesce(num = floor(num), false)) AS whole, max(step) - min(step) AS spread, list(value ORDER BY place) AS sample, {_HITS} FROM steps GROUP BY ALL),
pat AS (SELECT *, list_filter([{", ".join(f"CASE WHEN h_{n} >= greatest(1, \"values\" // 3) THEN '{n}' END" for n in names.PATTERNS)}], lambda x: x IS NOT NULL) AS patterns FROM stats JOIN ent USING (source_table, column_name)),
prof AS (SELECT *, CASE WHEN list_contains(patterns, 'date_iso_pattern') THEN 'date' WHEN list_contains(patterns, 'email_pattern') THEN 'email' WHEN list_contains(patterns, 'url_pattern') THEN 'url' WHEN list_contains(patterns, 'uuid_pattern') THEN 'uuid'
  WHEN numeric_ratio > 0.8 AND whole AND "values" >= 3 AND spread < 0.01 THEN 'sequence' WHEN numeric_ratio > 0.8 AND point THEN 'decimal' WHEN numeric_ratio > 0.8 THEN 'integer'
  WHEN avg_len > 100 THEN 'long' WHEN avg_len > 40 THEN 'phrase' WHEN cardinality / "values" < 0.5 AND avg_len < 20 THEN 'category' WHEN avg_len < 20 AND numeric_ratio < 0.2 THEN 'short' ELSE 'text' END AS d FROM pat),
described AS (SELECT p.*, t.description FROM prof p JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in profile.DESCRIPTIONS.items())}) t(d, description) USING (d))"""
P = f"{S}, {_STATS}"
_SIBLINGS = "sib AS (SELECT a.source_table, a.column_name, list(replace(b.column_name, '_', ' ') ORDER BY b.column_name)[1:5] AS siblings FROM (SELECT DISTINCT source_table, column_name FROM cells) a JOIN (SELECT DISTINCT source_table, column_name FROM cells) b ON a.source_table = b.source_table AND a.column_name <> b.column_name GROUP BY ALL)"
_NULLS = "nulls AS (SELECT source_table, column_name, round(avg(CASE WHEN value IS NULL OR value = '' THEN 1.0 ELSE 0 END), 4) AS null_ratio FROM cells GROUP BY ALL)"


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile(_sample(spark, sf, SAMPLE))


def _columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c) for t, cs in COLUMNS.items() for c in cs], "source_table string, column_name string")


@query("f01_sample_frequent", S + " SELECT * FROM sampled")
def sample_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf, SAMPLE)


@query("f01_sample_head", f"WITH {_CELLS}, {_COUNTS} SELECT *, row_number() OVER (PARTITION BY source_table, column_name ORDER BY value) AS place FROM counts QUALIFY place <= 7")
def sample_head(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf, 7, "head")


@query("f01_sample_random", f"WITH {_CELLS}, {_COUNTS} SELECT *, row_number() OVER (PARTITION BY source_table, column_name ORDER BY md5('s1' || value)) AS place FROM counts QUALIFY place <= 7")
def sample_random(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf, 7, "random", "s1")


@query("d05_profile", P + ' SELECT source_table, column_name, "values", cardinality, entropy, avg_len, numeric_ratio FROM described')
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).select(*profile.KEY, "values", "cardinality", "entropy", "avg_len", "numeric_ratio")


@query("d06_patterns", P + " SELECT source_table, column_name, array_to_string(patterns, ',') AS patterns FROM described")
def column_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).select(*profile.KEY, F.array_join("patterns", ",").alias("patterns"))


@query("b10_token_patterns", "WITH t AS (SELECT source, unnest(string_split_regex(text, '\\s+')) AS w FROM documents) SELECT source, " + ", ".join(f"count(*) FILTER (regexp_matches(w, '{p}')) AS {n}" for n, p in names.PATTERNS.items()) + " FROM t GROUP BY 1")
def token_patterns(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("source", F.explode(F.split("text", r"\s+")).alias("w"))
    return t.groupBy("source").agg(*(F.count_if(F.col("w").rlike(p)).alias(n) for n, p in names.PATTERNS.items()))


@query("b11_value_type", f"""WITH {_CELLS}, s AS (SELECT source_table, column_name, avg((lower(trim(value)) IN ('true', 'false'))::INT) AS b, avg(regexp_matches(trim(value), '^[+-]?\\d+$')::INT) AS i, avg(regexp_matches(trim(value), '{names.NUMBER}')::INT) AS f FROM cells WHERE value <> '' GROUP BY ALL)
SELECT source_table, column_name, CASE WHEN b = 1 THEN 'BOOL' WHEN i >= 0.8 THEN 'INT' WHEN f >= 0.8 THEN 'FLOAT' ELSE 'STRING' END AS type FROM s""")
def value_types(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_type(cells(spark, sf))


@query("b12_description", P + " SELECT source_table, column_name, description FROM described")
def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).select(*profile.KEY, "description")


_TEXT = """concat_ws(' | ', replace(column_name, '_', ' '), array_to_string([v[1:80] FOR v IN sample[1:5]], ', '), 'cardinality=' || cardinality, CASE WHEN null_ratio > 0 THEN 'null_ratio=' || round(null_ratio::DECIMAL(18, 4), 2)::DECIMAL(18, 2) END,
CASE WHEN entropy > 0 THEN 'entropy=' || round(entropy::DECIMAL(18, 4), 2)::DECIMAL(18, 2) END, CASE WHEN len(patterns) > 0 THEN 'patterns: ' || array_to_string(patterns, ', ') END, printf('avg_len=%.1f', round(avg_len, 1)), CASE WHEN numeric_ratio > 0 THEN 'numeric=' || round(numeric_ratio::DECIMAL(18, 4), 2)::DECIMAL(18, 2) END,
'siblings: ' || array_to_string(siblings, ', '), 'table=' || source_table, description)"""


def _described(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile(_sample(spark, sf, SAMPLE)).join(profile.null_ratio_tables(raw(spark, sf), DECIMALS), profile.KEY).join(profile.siblings(_columns(spark)), profile.KEY)


@query("b13_embedding_text", P + f", {_SIBLINGS}, {_NULLS} SELECT source_table, column_name, {_TEXT} AS text FROM described JOIN sib USING (source_table, column_name) JOIN nulls USING (source_table, column_name)")
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf).select(*profile.KEY, profile.embedding_text().alias("text"))


@query("b14_short_text", P + " SELECT source_table, column_name, concat_ws(' | ', column_name, array_to_string([v[1:80] FOR v IN sample[1:5]], ' ')) AS text FROM described")
def short_text(spark: SparkSession, sf: str) -> DataFrame:
    values = F.array_join(F.transform(F.slice("sample", 1, 5), lambda v: F.substring(v, 1, 80)), " ")
    return _profile(spark, sf).select(*profile.KEY, F.concat_ws(" | ", "column_name", values).alias("text"))


@query("b15_discrete_vector", P + f""", {_NULLS} SELECT source_table, column_name, i, round(x * sqrt(64 / 11.0), 4) AS x FROM (SELECT source_table, column_name, unnest([cardinality::DOUBLE, null_ratio, entropy, {", ".join(f"list_contains(patterns, '{n}')::INT" for n in names.PATTERNS)}]) AS x, unnest(range(0, {3 + len(names.PATTERNS)})) AS i FROM described JOIN nulls USING (source_table, column_name))""")
def discrete_vector(spark: SparkSession, sf: str) -> DataFrame:
    v = _described(spark, sf).withColumn("v", profile.discrete_vector(64))
    return v.select(*profile.KEY, F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 4))


@query("c09_siblings", f"WITH {_CELLS}, {_SIBLINGS} SELECT source_table, column_name, array_to_string(siblings, ',') AS siblings FROM sib")
def siblings(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.siblings(cells(spark, sf).select(*profile.KEY).distinct())
    return found.select(*profile.KEY, F.array_join("siblings", ",").alias("siblings"))


@query("b09_names", """SELECT DISTINCT p_name, p_type, replace(replace(p_name, ' ', '_'), '_', ' ') AS human, lower(regexp_replace(replace(p_type, '-', '_'), '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake,
regexp_matches(p_type, '(?i)^(col\\d*|column\\d*|field\\d*|var\\d*|unnamed.*|\\d+|_|)$') AS generic FROM part""")
def name_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_name", "p_type").distinct().withColumn("n", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return p.select("p_name", "p_type", names.humanised("n").alias("human"), names.snake("p_type").alias("snake"), names.is_generic("p_type").alias("generic"))


def _schema(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up tables, one for each part brand and size, whose columns are elements' words and <table>_id."""
    p = table(spark, sf, "part")
    words = [w for _, _, some in profile.ELEMENTS for w in some]
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    a = p.select(F.concat(F.lit("t"), F.col("p_size")).alias("source_table"), word.alias("column_name"))
    b = p.select(F.concat(F.lit("t"), F.col("p_size")).alias("source_table"), F.concat(F.lit("t"), F.expr("p_partkey % 60"), F.lit("_id")).alias("column_name"))
    c = p.select(F.concat(F.lit("T"), F.expr("p_size + 30"), F.lit("s")).alias("source_table"), F.lit("value").alias("column_name"))
    return a.unionByName(b).unionByName(c).distinct()


_WORDS = [w for _, _, some in profile.ELEMENTS for w in some]
_SCHEMA = f"""cols AS (SELECT DISTINCT * FROM (SELECT 't' || p_size AS source_table, ([{", ".join(f"'{w}'" for w in _WORDS)}])[p_partkey % {len(_WORDS)} + 1] AS column_name FROM part
UNION ALL SELECT 't' || p_size, 't' || (p_partkey % 60) || '_id' FROM part UNION ALL SELECT 'T' || (p_size + 30) || 's', 'value' FROM part))"""


@query("c10_foreign_keys", f"""WITH {_SCHEMA}, cand AS (SELECT source_table, column_name, unnest([1, 2, 3]) AS place, unnest([c, c || 's', c || 'es']) AS candidate FROM (SELECT *, regexp_replace(column_name, '_id$', '') AS c FROM cols WHERE column_name LIKE '%\\_id' ESCAPE '\\')),
t AS (SELECT DISTINCT source_table AS target_table FROM cols) SELECT source_table, column_name, arg_min(target_table, place) AS target_table FROM cand JOIN t ON candidate = lower(target_table) WHERE lower(source_table) <> candidate GROUP BY ALL""")
def foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    return profile.foreign_keys(_schema(spark, sf))


_INDICATORS = "ind(element, word) AS (VALUES " + ", ".join(f"('{e}', '{w}')" for e, _, some in profile.ELEMENTS for w in some) + ")"


@query("c11_elements", f"""WITH {_SCHEMA}, {_INDICATORS}, found AS (SELECT DISTINCT source_table, column_name, element FROM cols JOIN ind ON contains(column_name, word) OR contains(word, column_name) OR (contains(word, '_') AND list_has_all(string_split(column_name, '_'), string_split(word, '_'))))
SELECT source_table, element, column_name, CASE WHEN column_name LIKE '%\\_id' ESCAPE '\\' OR column_name = 'id' THEN 'identifier' WHEN regexp_matches(column_name, 'date|time|created|updated') THEN 'temporal' WHEN regexp_matches(column_name, '_ref|_fk') THEN 'reference' ELSE 'attribute' END AS role
FROM found WHERE (source_table, element) IN (SELECT (source_table, element) FROM found GROUP BY source_table, element HAVING count(*) >= 2)""")
def elements(spark: SparkSession, sf: str) -> DataFrame:
    return profile.elements(_schema(spark, sf))


_C13 = f"""WITH {_SCHEMA}, {_INDICATORS}, found AS (SELECT DISTINCT source_table, column_name, element FROM cols JOIN ind ON contains(column_name, word) OR contains(word, column_name) OR (contains(word, '_') AND list_has_all(string_split(column_name, '_'), string_split(word, '_'))))"""


@query("c13_element_lookup", _C13 + """ SELECT element, string_agg(DISTINCT source_table, ',' ORDER BY source_table) AS tables, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS members FROM found WHERE (source_table, element) IN (SELECT (source_table, element) FROM found GROUP BY source_table, element HAVING count(*) >= 2) GROUP BY 1""")
def element_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of the same name merged across tables."""
    return profile.lookup(profile.elements(_schema(spark, sf)), "element", tables="source_table", members="column_name")


_FOUND = "(SELECT * FROM found WHERE (source_table, element) IN (SELECT (source_table, element) FROM found GROUP BY source_table, element HAVING count(*) >= 2))"


@query("c13_by_table", _C13 + f" SELECT source_table, string_agg(DISTINCT element, ',' ORDER BY element) AS elements FROM {_FOUND} GROUP BY 1")
def elements_by_table(spark: SparkSession, sf: str) -> DataFrame:
    return profile.lookup(profile.elements(_schema(spark, sf)), "source_table", elements="element")


@query("c13_by_column", _C13 + f" SELECT column_name, string_agg(DISTINCT element, ',' ORDER BY element) AS elements FROM {_FOUND} GROUP BY 1")
def elements_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return profile.lookup(profile.elements(_schema(spark, sf)), "column_name", elements="element")


@query("b19_resolve", """WITH v AS (SELECT min(p_partkey) AS id, p_type AS name FROM part GROUP BY p_type), w AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN x WHEN 1 THEN lower(x) ELSE 'none' || x END AS label FROM (SELECT o_orderkey, (SELECT list(name ORDER BY name) FROM v)[o_orderkey % (SELECT count(*) FROM v) + 1] AS x FROM orders))
SELECT o_orderkey, coalesce(e.id, i.id) AS id FROM w LEFT JOIN v e ON w.label = e.name LEFT JOIN (SELECT lower(name) AS l, min(id) AS id FROM v GROUP BY 1) i ON lower(w.label) = i.l""")
def resolve(spark: SparkSession, sf: str) -> DataFrame:
    from varve.operators.evidence import resolve_labels

    v = table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    names_list = [r.name for r in v.select("name").orderBy("name").collect()]  # a handful of part types
    part = F.col("o_orderkey") % 3
    x = F.element_at(F.array(*map(F.lit, names_list)), (F.col("o_orderkey") % len(names_list) + 1).cast("int"))
    w = table(spark, sf, "orders").select("o_orderkey", F.when(part == 0, x).when(part == 1, F.lower(x)).otherwise(F.concat(F.lit("none"), x)).alias("label"))
    return resolve_labels(w, v, "label").select("o_orderkey", "id")
