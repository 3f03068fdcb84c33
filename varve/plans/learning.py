"""Labels passed on, taxonomies, importance, trained models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import labels, ledger, models
from varve.plans import fixtures as fx
from varve.plans.history import FOLD
from varve.registry import query
from varve.session import table


@query("b08_metric_names", "SELECT CASE event_type WHEN 'click' THEN 'app.clicks' WHEN 'error' THEN 'app.errors' ELSE event_type END AS metric, CASE WHEN event_type IN ('click', 'error') THEN 'count' ELSE '1' END AS unit, CASE event_type WHEN 'error' THEN 'counter' ELSE 'gauge' END AS kind, 'gpu.dev=' || (user_id % 6) AS label, count(*) AS n FROM events GROUP BY ALL")
def metric_names(spark: SparkSession, sf: str) -> DataFrame:
    fields = spark.createDataFrame([("CLICK", "app.clicks", "count", None), ("ERROR", "app.errors", "count", "counter")], "name string, metric string, unit string, kind string")
    e = table(spark, sf, "events").select(F.upper("event_type").alias("name"), F.create_map(F.lit("DEV"), F.expr("cast(user_id % 6 AS string)")).alias("labels"), "value")
    named = labels.metric_names(e, fields).withColumn("label", F.concat(F.lit("gpu.dev="), F.col("labels")["gpu.dev"]))
    return named.groupBy("metric", "unit", "kind", "label").agg(F.count("*").alias("n"))


@query("b20_sensitivity", "SELECT p_type AS code, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'restricted' ELSE 'internal' END AS level, 'GOV_' || p_type || '_' || replace(p_brand, '#', '') AS name, count(*) AS n FROM part GROUP BY ALL")
def sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    levels = spark.createDataFrame([("ECONOMY", "restricted"), ("PROMO", "restricted")], "code string, level string")
    p = table(spark, sf, "part").select(F.col("p_type").alias("code"), labels.governance_name("GOV", F.col("p_type"), F.col("p_brand")).alias("name"))
    return labels.sensitivity(p, levels).groupBy("code", "level", "name").agg(F.count("*").alias("n"))


_CODES = ["0070", "0073", "0075", "0085", "0084", "0071", "0026", "0001"]
_CODED = f"coded AS (SELECT p_brand AS source_table, p_name AS column_name, ([{', '.join(repr(c) for c in _CODES)}])[p_partkey % 23 % 8 + 1] AS code FROM part)"


@query("c12_refine_elements", f"""WITH {_CODED}, aff(element, code) AS (VALUES {", ".join(f"('{e}', '{c}')" for e, cs in labels.AFFINITIES.items() for c in cs)}), h AS (SELECT * FROM coded JOIN aff USING (code) WHERE element <> 'PaymentCard'),
f AS (SELECT element, min(source_table) AS source_table FROM (SELECT element, source_table FROM h GROUP BY ALL HAVING count(DISTINCT code) >= 2) GROUP BY 1) SELECT element, source_table, column_name FROM h JOIN f USING (element, source_table)""")
def refine_elements(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % 23 % 8 + 1).cast("int"))
    coded = table(spark, sf, "part").select(F.col("p_brand").alias("source_table"), F.col("p_name").alias("column_name"), code.alias("code"))
    return labels.refine_elements(coded, spark.createDataFrame([("PaymentCard",)], "element string"))


@query("c16_propagation", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT * FROM e WHERE vec_id % 10 = 0), t AS (SELECT * FROM e WHERE vec_id % 10 <> 0),
m AS (SELECT t.vec_id AS item, s.vec_id AS place, s.label, list_dot_product(t.v, s.v) / (t.n * s.n) AS sim FROM t, s WHERE list_dot_product(t.v, s.v) / (t.n * s.n) >= 0.3 AND NOT (t.vec_id % 4 = 1 AND s.label <> 3))
SELECT item, 'c' || arg_min(label, place) AS code, round(arg_min(sim, place) * 0.8, 6) AS confidence FROM m GROUP BY 1""")
def propagation(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    e = table(spark, sf, "embeddings").withColumn("n", norm).withColumn("vector", F.transform(v, lambda x: x / F.col("n")))
    targets = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("item"), "vector", F.when(F.col("vec_id") % 4 == 1, "c3").alias("guess"), F.lit(0.9).alias("guess_confidence"))
    sources = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("place"), "vector", F.concat(F.lit("c"), "label").alias("code"), F.lit(0.8).alias("confidence"))
    return labels.propagate(targets, sources, similarity=0.3).withColumn("confidence", F.round("confidence", 6))


@query("c18_header_truth", "SELECT p_brand AS source_table, p_type AS column_name, lpad((p_size % 20)::VARCHAR, 4, '0') AS code FROM (SELECT p_brand, p_type, min(p_size) AS p_size FROM part GROUP BY ALL) WHERE p_size % 20 < 15")
def header_truth(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("p_size"))
    pair = F.array(F.col("p_type"), F.concat(F.lit("ref_"), F.lpad(F.expr("cast(p_size % 20 AS string)"), 4, "0")))
    tables = p.groupBy(F.col("p_brand").alias("source_table")).agg(F.flatten(F.collect_list(pair)).alias("headers"))
    codes = spark.range(15).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("code"))
    return labels.truth_from_headers(tables, codes)


@query("e02_paired", """WITH c AS (SELECT o_custkey AS source_table, o_orderkey AS ordinal, CASE WHEN o_orderkey % 2 = 0 THEN 'annotation' ELSE 'data' END AS kind, 'c' || (o_orderkey % 9) AS code, (o_orderkey % 10) / 10.0 AS confidence FROM orders),
l AS (SELECT *, lag(kind) OVER w AS k, lag(code) OVER w AS lc, lag(confidence) OVER w AS f FROM c WINDOW w AS (PARTITION BY source_table ORDER BY ordinal)), p AS (SELECT *, coalesce(kind = 'annotation' AND k = 'data' AND f >= 0.35 AND confidence < 0.5, false) AS paired FROM l)
SELECT source_table, ordinal, CASE WHEN paired THEN lc ELSE code END AS code, round(CASE WHEN paired THEN f * 0.9 ELSE confidence END, 6)::DOUBLE AS confidence, paired FROM p""")
def paired(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_table"), k.alias("ordinal"), F.when(k % 2 == 0, "annotation").otherwise("data").alias("kind"), F.concat(F.lit("c"), k % 9).alias("code"), (k % 10 / 10.0).alias("confidence"))
    return labels.paired(rows).withColumn("confidence", F.round("confidence", 6))


@query("d15_paths", "SELECT 'n' || n_nationkey AS code, '[\"n' || n_nationkey || '\",\"r' || n_regionkey || '\",\"root\"]' AS path FROM nation")
def paths(spark: SparkSession, sf: str) -> DataFrame:
    from varve.operators import evidence

    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("root").alias("parent"))
    c = evidence.closure(n.unionByName(r))
    depth = c.select("ancestor").distinct().withColumn("depth", F.when(F.col("ancestor") == "root", 0).when(F.col("ancestor").startswith("r"), 1).otherwise(2))
    return labels.paths(c.where(F.col("code").startswith("n")), depth)


@query("d17_taxonomy", """WITH a AS (SELECT DISTINCT p_type || '.' || p_brand || '.' || p_size AS code FROM part WHERE p_partkey % 5 <> 2), x AS (SELECT code FROM a UNION SELECT regexp_replace(code, '\\.[^.]*$', '') FROM a UNION SELECT regexp_replace(code, '\\..*$', '') FROM a)
SELECT code, CASE WHEN contains(code, '.') THEN regexp_replace(code, '\\.[^.]*$', '') END AS parent, code IN (SELECT code FROM a) AS leaf FROM x""")
def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat_ws(".", "p_type", "p_brand", "p_size")
    a = table(spark, sf, "part").groupBy(code.alias("code")).agg(F.min(F.col("p_partkey") % 5 == 2).alias("deprecated"), F.first("p_name").alias("label"))
    return labels.taxonomy(a).select("code", "parent", "leaf")


@query("d21_bootstrap", "SELECT round(avg((o_orderkey % 4 <> 0)::INT), 4) AS coverage, round(avg(o_orderkey % 10 / 10.0), 4) AS mean_conflict, count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 4 <> o_custkey % 3 AND o_orderkey % 10 > 2) AS disagreements, count(*) FILTER (o_orderkey % 4 = 0 AND o_custkey % 10 >= 5) AS filled FROM orders")
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 4).alias("label"), (F.col("o_custkey") % 3).alias("guess"), (F.col("o_orderkey") % 10 / 10.0).alias("conflict"), (F.col("o_custkey") % 10 / 10.0).alias("guess_confidence"))
    return labels.bootstrap_figures(rows)


def _loss(rows: pd.DataFrame) -> pd.Series:
    """Cross entropy of a fixed linear model over two features."""
    p = 1 / (1 + np.exp(-(3 * rows["a"] - 0.01 * rows["b"])))
    return pd.Series(-np.log(np.where(rows["truth"] == 1, p, 1 - p) + 1e-12))


@query("d22_importance")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    """Of the two features of a fixed model only the first matters; see the tests."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("place"), F.element_at("embedding", 1).cast("double").alias("a"), F.element_at("embedding", 2).cast("double").alias("b"))
    return labels.importance(e.withColumn("truth", (F.col("a") > 0).cast("int")), _loss, ["a", "b"], 8)


@query("d23_contributions", """WITH l AS (SELECT vec_id AS item, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS i FROM embeddings), g AS (SELECT item, 'g' || (i // 8) AS name, sum(x) AS value FROM l GROUP BY ALL)
SELECT item, name, round(value, 5) AS value, row_number() OVER (PARTITION BY item ORDER BY abs(value) DESC, name) AS place FROM g QUALIFY place <= 3""")
def contributions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("contributions"))
    return labels.top_contributions(e, [f"g{i // 8}" for i in range(64)], 3).withColumn("value", F.round("value", 5))


@query("d38_cells", FOLD + """, b AS (SELECT observer, proposition % 5 AS site, CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'mid' ELSE 'high' END AS momentum, engine_rev, count(*) AS n, count(outcome) AS resolved, round(avg((p - outcome::INT) * (p - outcome::INT))::DECIMAL(18, 10), 4)::DOUBLE AS brier FROM folded GROUP BY ALL)
SELECT *, round((CASE WHEN brier IS NULL THEN 0.5 ELSE resolved / (resolved + 2.0) * (1 - brier) + 1.0 / (resolved + 2.0) END)::DECIMAL(18, 10), 4)::DOUBLE AS alpha, coalesce(brier, 0.5) AS risk FROM b""")
def cells(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("p") < 0.3, "low").when(F.col("p") < 0.7, "mid").otherwise("high")
    obs = ledger.folded(fx.ledger(spark, sf)).withColumn("site", F.col("proposition") % 5).withColumn("momentum", bucket)
    return ledger.trust(ledger.brier(obs, ["observer", "site", "momentum", "engine_rev"]))


@query("m1_lexical")
def lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each document from its text (null: empty), trained on nine tenths of the ids; the others are held out."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    model = models.lexical(d.where("text IS NOT NULL AND doc_id % 10 <> 0"), "lang")
    scored = models.applied(model, d)
    names = model.labels
    return scored.select("doc_id", "lang", F.element_at(F.array(*map(F.lit, names)), (F.col("prediction") + 1).cast("int")).alias("code"), F.expr("coalesce(doc_id % 10 = 0, true)").alias("held_out"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "embedding", F.slice("embedding", 1, 8).alias("part"), F.concat(F.lit("c"), "label").alias("code"))
    return models.scaled(e, ["embedding", "part"])


@query("m2_forest")
def forest(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf).select("item", "features", "code")
    model = models.forest(f.where("item % 5 <> 0"), "code")
    scored = models._predict(model, f.withColumn("truth", F.col("code")))
    return scored.select("item", "code", F.round("confidence", 6).alias("confidence"), "truth", F.expr("coalesce(item % 5 = 0, true)").alias("held_out"))


@query("m2_boosted")
def boosted(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees, one class against the rest: code, probabilities and how far the members of the ensemble differ."""
    f = _features(spark, sf).select("item", "features", "code")
    model = models.boosted(f.where("item % 5 <> 0"))
    scored = models.boosted_probabilities(model, f.select("item", "features", F.col("code").alias("truth")))
    return scored.select("item", "code", F.round("confidence", 6).alias("confidence"), F.round("variance", 6).alias("variance"), "probabilities", "truth", F.expr("coalesce(item % 5 = 0, true)").alias("held_out"))


@query("m3_folds", "SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR)) - 1) % 5 AS fold FROM labels")
def folds(spark: SparkSession, sf: str) -> DataFrame:
    return labels.folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


@query("m3_out_of_fold")
def out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Each item predicted by the forest of the other folds; the reference items are in every training set and in no fold."""
    f = _features(spark, sf).select("item", "features", "code")
    return models.out_of_fold(f.where("item % 20 <> 0"), f.where("item % 20 = 0"), 3).select("item", "fold", "code", F.round("confidence", 6).alias("confidence"), "truth")


@query("m3_full_fit")
def full_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the items has no label: they get the model of all labels, the others that of the other folds."""
    f = _features(spark, sf).select("item", "features", F.expr("CASE WHEN item % 3 <> 1 THEN code END").alias("code"))
    return models.full_fit(f.where("item % 20 <> 0"), f.where("item % 20 = 0 AND code IS NOT NULL"), 2).select("item", "fold", "code", F.round("confidence", 6).alias("confidence"), "truth")


@query("m4_cosines", """WITH e AS (SELECT vec_id AS item, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM e WHERE item % 5 <> 0) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS w FROM m GROUP BY 1), s AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY c.label) - 1 AS i, list_cosine_similarity(v, w) AS x FROM e, c)
SELECT item, i, round((x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i), 4) + 0.0 AS x FROM s""")
def cosines(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each item to the mean of each label's training rows, scaled like the other features."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector"), F.format_string("%02d", "label").alias("code"))
    means = e.where("item % 5 <> 0").groupBy("code").agg(Summarizer.mean(models.array_to_vector("vector")).alias("mean")).select("code", vector_to_array("mean").alias("vector"))
    parts = models.scaled(models.category_cosines(e, means).select("item", "cosines"), ["cosines"])
    return parts.select("item", F.posexplode(vector_to_array("features")).alias("i", "x")).withColumn("x", F.round("x", 4) + 0.0)


@query("m1_probabilities")
def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated probabilities of the language; the model is written and read back before it scores."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    train = d.where("text IS NOT NULL AND doc_id % 10 <> 0")
    fitted = models.lexical(train.where("doc_id % 10 > 2"), "lang")
    model = models.saved(models.calibrated(fitted, train.where("doc_id % 10 <= 2")), spark)
    scored = models.probabilities(model, d)
    return scored.select("doc_id", "lang", "code", F.round("confidence", 6).alias("confidence"), "probabilities", F.expr("coalesce(doc_id % 10 = 0, true)").alias("held_out"))


@query("m4_scaled", """WITH e AS (SELECT vec_id AS item, unnest(embedding::DOUBLE[] || embedding[1:8]::DOUBLE[]) AS x, unnest(range(0, 72)) AS i FROM embeddings)
SELECT item, i, round((x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i), 4) + 0.0 AS x FROM e""")
def scaled(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return _features(spark, sf).select("item", F.posexplode(vector_to_array("features")).alias("i", "x")).withColumn("x", F.round("x", 4) + 0.0)


@query("m5_self_training")
def self_training(spark: SparkSession, sf: str) -> DataFrame:
    """Every unlabelled item with the code it got and the round; null where no round was sure."""
    f = _features(spark, sf).select("item", "features", "code")
    rest = f.where("item % 4 <> 0").drop("code")
    sure = models.self_train(f.where("item % 4 = 0"), rest)
    return rest.select("item").join(sure, "item", "left")


@query("m6_synthetic_columns", """WITH c AS (SELECT DISTINCT p_brand AS code, p_brand || ' Name' AS label FROM part), b AS (SELECT code, label, unnest(range(0, 6)) AS variant FROM c), s AS (SELECT *, md5(code || '/' || variant) AS seed, lower(regexp_replace(label, '[^A-Za-z0-9]+', '_', 'g')) AS word FROM b),
w AS (SELECT *, variant % 2 = 1 AS opaque, CASE WHEN variant % 2 = 1 THEN 'c' || seed[1:6] ELSE CASE variant % 4 WHEN 0 THEN word ELSE upper(word) END || '_' || variant END AS column_name, unnest(range(0, 20)) AS row FROM s),
h AS (SELECT *, md5(seed || '/' || row) AS h, ('0x' || md5(code)[1:4])::INT % 4 AS kind FROM w), v AS (SELECT *, ('0x' || h[1:7])::BIGINT AS digits FROM h)
SELECT code, column_name, opaque, row, CASE kind WHEN 0 THEN h[1:8] || '@example.org' WHEN 1 THEN digits::VARCHAR WHEN 2 THEN '20' || lpad((digits % 30)::VARCHAR, 2, '0') || '-01-02' ELSE h END AS value FROM v""")
def synthetic(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").select(F.col("p_brand").alias("code"), F.concat("p_brand", F.lit(" Name")).alias("label")).distinct()
    return models.synthetic_columns(c, 6, 20)


@query("m7_vectors")
def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    v = models.vectors(table(spark, sf, "pages").select("page_id", F.col("url").alias("text")))
    norm = F.aggregate(F.transform(vector_to_array("vector"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return v.select("page_id", F.round(norm, 6).alias("norm"))
