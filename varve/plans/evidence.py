"""Evidence, fusion, decisions and their evaluation, over embeddings and their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.operators import evidence
from varve.plans import columns as pc
from varve.registry import query
from varve.session import table

PAIRS = [("c0", "c1"), ("c2", "c3"), ("c3", "c4")]
R = 6  # digits compared


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("c"), "label").alias("code")).distinct()


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "a string, b string")


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.concat(F.lit("c"), "label").alias("code"), F.col("embedding").alias("vector"))
    long = e.select("code", F.posexplode("vector").alias("i", "x"))
    mean = long.groupBy("code", "i").agg(F.round(F.avg("x"), 6).alias("x"))
    cats = mean.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("code", F.col("v.x").alias("vector"))
    return e, cats


def sims(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.cosine(*_vectors(spark, sf))


_SIMS = """e AS (SELECT vec_id AS item, 'c' || label AS code, embedding::DOUBLE[] AS vector FROM embeddings),
cats AS (SELECT code, list(x ORDER BY i) AS vector FROM (SELECT code, i, round(avg(x), 6) AS x FROM (SELECT code, unnest(vector) AS x, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) GROUP BY 1),
sims AS (SELECT e.item, c.code, list_cosine_similarity(e.vector, c.vector) AS sim FROM e, cats c)"""
_COS = "cosm AS (SELECT item, 'cosine' AS source, code AS focal, 0.7 * exp(sim) / sum(exp(sim)) OVER (PARTITION BY item) AS mass FROM sims)"
_PROBA = "proba AS (SELECT vec_id AS item, 'c' || k AS code, (1 + (vec_id * 7 + k * 3) % 5) / 40.0 + CASE WHEN label = k THEN 0.1 ELSE 0 END AS p FROM embeddings, (SELECT unnest(range(0, 11)) AS k))"
_LEX = "lexm AS (SELECT item, 'lexical' AS source, code AS focal, p * 0.8 AS mass FROM proba WHERE code IN (SELECT code FROM cats))"


def proba(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up probabilities of eleven codes, one outside the frame."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    p = (1 + (F.col("vec_id") * 7 + F.col("k") * 3) % 5) / 40.0 + F.when(F.col("label") == F.col("k"), 0.1).otherwise(0.0)
    return e.select(F.col("vec_id").alias("item"), F.concat(F.lit("c"), "k").alias("code"), p.alias("p"))


@query("c15_cosine", f"WITH {_SIMS} SELECT item, code, round(sim, {R}) AS sim FROM sims")
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    return sims(spark, sf).withColumn("sim", F.round("sim", R))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("item", "focal", F.round("mass", R).alias("mass"))


@query("d07_similarity_mass", f"WITH {_SIMS}, {_COS} SELECT item, focal, round(mass, {R}) AS mass FROM cosm UNION ALL SELECT item, '*', 0.3 FROM e")
def similarity_mass(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evidence.from_similarity(sims(spark, sf)))


@query("d08_probability_mass", f"WITH {_SIMS}, {_PROBA}, {_LEX} SELECT item, focal, round(mass, {R}) AS mass FROM lexm UNION ALL SELECT item, '*', round(1 - sum(mass), {R}) FROM lexm GROUP BY 1")
def probability_mass(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evidence.from_probabilities(proba(spark, sf), frame(spark, sf)))


@query("d08_ensemble_mass", f"WITH {_SIMS}, {_PROBA}, m AS (SELECT item, code AS focal, p * (1 - least(0.5, 0.1 + (item % 4) / 10.0 * 1.6)) AS mass FROM proba WHERE code IN (SELECT code FROM cats)) SELECT item, focal, round(mass, {R}) AS mass FROM m UNION ALL SELECT item, '*', round(1 - sum(mass), {R}) FROM m GROUP BY 1")
def ensemble_mass(spark: SparkSession, sf: str) -> DataFrame:
    p = proba(spark, sf).withColumn("variance", F.col("item") % 4 / 10.0)
    return _shown(evidence.from_probabilities(p, frame(spark, sf), evidence.ensemble_discount("variance"), "boosted"))


_PATTERN_CODES = {"email_pattern": "c1", "phone_pattern": "c2", "ipv4_pattern": "c3", "url_pattern": "c3", "ssn_pattern": "c99"}


@query("d09_pattern_mass", "WITH t AS (SELECT DISTINCT doc_id AS item, unnest([" + ", ".join(f"CASE WHEN regexp_matches(w, '{pc.names.PATTERNS[p]}') THEN '{c}' END" for p, c in _PATTERN_CODES.items() if c != "c99") + """]) AS code FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents)),
m AS (SELECT item, code AS focal, 0.9 / count(*) OVER (PARTITION BY item) AS mass FROM t WHERE code IS NOT NULL) SELECT item, focal, round(mass, 6) AS mass FROM m UNION ALL SELECT doc_id, '*', CASE WHEN doc_id IN (SELECT item FROM m) THEN 0.1 ELSE 1.0 END FROM documents""")
def pattern_mass(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.explode_outer(F.split("text", r"\s+")).alias("w"))
    # words are reduced to a flag a pattern before anything is shuffled or joined
    hits = w.groupBy("item").agg(*(F.max(F.col("w").rlike(pc.names.PATTERNS[p])).alias(p) for p in _PATTERN_CODES))
    found = F.explode_outer(F.filter(F.array(*(F.when(F.col(p), p) for p in _PATTERN_CODES)), lambda x: x.isNotNull()))
    mapping = spark.createDataFrame(list(_PATTERN_CODES.items()), "pattern string, code string")
    return _shown(evidence.from_patterns(hits.select("item", found.alias("pattern")), mapping, frame(spark, sf)))


@query("d10_answer_mass", f"""WITH {_SIMS}, a AS (SELECT vec_id AS item, 'c' || (vec_id % 11) AS code, (vec_id % 10) / 10.0 AS confidence, 'c' || (vec_id % 7) AS c1, 'c' || (vec_id % 12) AS c2 FROM embeddings),
g AS (SELECT * FROM a WHERE code IN (SELECT code FROM cats)), m AS (SELECT item, code, confidence * 0.9 AS mass FROM g UNION ALL SELECT item, c1, 0.75 * (0.9 - confidence * 0.9) FROM g UNION ALL SELECT item, c2, 0.25 * (0.9 - confidence * 0.9) FROM g WHERE c2 IN (SELECT code FROM cats)),
s AS (SELECT item, code AS focal, sum(mass) AS mass FROM m GROUP BY ALL) SELECT item, focal, round(mass, {R}) AS mass FROM s UNION ALL SELECT item, '*', round(1 - sum(mass), {R}) FROM s GROUP BY 1""")
def answer_mass(spark: SparkSession, sf: str) -> DataFrame:
    code = lambda n: F.concat(F.lit("c"), F.col("vec_id") % n)
    alternatives = F.array(F.struct(code(7).alias("code"), F.lit(0.6).alias("confidence")), F.struct(code(12).alias("code"), F.lit(0.2).alias("confidence")))
    a = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), code(11).alias("code"), (F.col("vec_id") % 10 / 10.0).alias("confidence"), alternatives.alias("alternatives"))
    return _shown(evidence.from_answers(a, frame(spark, sf)))


_PAIRS = "pairs(a, b) AS (VALUES " + ", ".join(str(p) for p in PAIRS) + ")"


def _paired(m: str, out: str) -> str:
    """SQL of share_with_pairs over the singletons of m."""
    return f"""{out}_r AS (SELECT *, row_number() OVER w AS rank, first_value(focal) OVER w AS f1, nth_value(focal, 2) OVER w AS f2, first_value(mass) OVER w AS m1, nth_value(mass, 2) OVER w AS m2 FROM {m}
  WINDOW w AS (PARTITION BY item, source ORDER BY mass DESC, focal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{out}_x AS (SELECT r.*, a, b FROM {out}_r r LEFT JOIN pairs ON least(f1, f2) = a AND greatest(f1, f2) = b AND m1 < 3 * m2),
{out} AS (SELECT item, source, focal, CASE WHEN a IS NOT NULL AND rank = 2 THEN mass / 2 ELSE mass END AS mass FROM {out}_x UNION ALL SELECT item, source, a || '|' || b, mass / 2 FROM {out}_x WHERE a IS NOT NULL AND rank = 2)"""


@query("d11_pairs", f"WITH {_SIMS}, {_PAIRS}, {_COS}, {_paired('cosm', 'cosp')} SELECT item, focal, round(mass, {R}) AS mass FROM cosp UNION ALL SELECT item, '*', 0.3 FROM e")
def with_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evidence.share_with_pairs(evidence.from_similarity(sims(spark, sf)), pairs(spark)))


def masses(spark: SparkSession, sf: str, without: str = "") -> DataFrame:
    sources = {"cosine": evidence.from_similarity(sims(spark, sf)), "lexical": evidence.from_probabilities(proba(spark, sf), frame(spark, sf))}
    return evidence.share_with_pairs(reduce(DataFrame.unionByName, (m for s, m in sources.items() if s != without)), pairs(spark))


def fused(spark: SparkSession, sf: str, without: str = "") -> DataFrame:
    return evidence.fuse(masses(spark, sf, without))


def _fuse_sql(sources: str) -> str:
    """Commonalities of every focal element, multiplied and inverted."""
    return f"""named AS ({sources}), src AS (SELECT item, source, 1 - sum(mass) AS theta FROM named GROUP BY ALL),
focals AS (SELECT code AS focal FROM cats UNION ALL SELECT a || '|' || b FROM pairs),
up AS (SELECT item, source, focal, mass FROM named UNION ALL SELECT item, source, unnest(string_split(focal, '|')), mass FROM named WHERE contains(focal, '|')),
q AS (SELECT s.item, f.focal, s.source, s.theta + coalesce(sum(u.mass), 0) AS q FROM src s CROSS JOIN focals f LEFT JOIN up u ON u.item = s.item AND u.source = s.source AND u.focal = f.focal GROUP BY s.item, f.focal, s.source, s.theta),
qa AS (SELECT item, focal, product(q) AS q FROM q GROUP BY ALL), th AS (SELECT item, product(theta) AS t FROM src GROUP BY 1),
pm AS (SELECT item, unnest(string_split(focal, '|')) AS focal, q - t AS m FROM qa JOIN th USING (item) WHERE contains(focal, '|')),
raw AS (SELECT qa.item, qa.focal, q - t - coalesce((SELECT sum(m) FROM pm WHERE pm.item = qa.item AND pm.focal = qa.focal), 0) AS m FROM qa JOIN th USING (item) UNION ALL SELECT item, '*', t FROM th),
clean AS (SELECT item, focal, CASE WHEN m < 1e-15 THEN 0 ELSE m END AS m FROM raw),
fused AS (SELECT item, focal, m / sum(m) OVER (PARTITION BY item) AS mass, 1 - sum(m) OVER (PARTITION BY item) AS conflict FROM clean)"""


_BOTH = f"WITH {_SIMS}, {_PAIRS}, {_COS}, {_paired('cosm', 'cosp')}, {_PROBA}, {_LEX}, {_paired('lexm', 'lexp')}, {_fuse_sql('SELECT * FROM cosp UNION ALL SELECT * FROM lexp')}"
_INTERVALS = """iv AS (SELECT f.item, c.code, any_value(conflict) AS conflict, sum(CASE WHEN focal = c.code THEN mass ELSE 0 END) AS bel, sum(CASE WHEN focal = '*' OR list_contains(string_split(focal, '|'), c.code) THEN mass ELSE 0 END) AS pl,
 sum(CASE WHEN focal = '*' THEN mass / (SELECT count(*) FROM cats) WHEN list_contains(string_split(focal, '|'), c.code) THEN mass / len(string_split(focal, '|')) ELSE 0 END) AS betp FROM fused f, cats c GROUP BY f.item, c.code)"""
_DECIDE = "best AS (SELECT * FROM iv QUALIFY row_number() OVER (PARTITION BY item ORDER BY betp DESC, code) = 1)"


@query("d12_fusion", f"{_BOTH} SELECT item, focal, round(mass, {R}) AS mass, round(conflict, {R}) AS conflict FROM fused WHERE mass > 1e-9")
def fusion(spark: SparkSession, sf: str) -> DataFrame:
    f = fused(spark, sf).where("mass > 1e-9")
    return f.select("item", "focal", F.round("mass", R).alias("mass"), F.round("conflict", R).alias("conflict"))


# --- inner nodes: codes c0, c3, ... lie under g0, and so on, these under root

GROUPS = 3


def tree(spark: SparkSession, sf: str) -> DataFrame:
    group = F.concat(F.lit("g"), F.substring("code", 2, 9).cast("int") % GROUPS)
    inner = spark.createDataFrame([("root", None), *((f"g{k}", "root") for k in range(GROUPS))], "code string, parent string")
    return frame(spark, sf).select("code", group.alias("parent")).unionByName(inner)


def inner_frame(spark: SparkSession, sf: str) -> evidence.Frame:
    return evidence.Frame.of(tree(spark, sf), PAIRS)


def inner_masses(spark: SparkSession, sf: str) -> DataFrame:
    """The two sources, and one that knows only the group."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.concat(F.lit("g"), F.col("vec_id") % GROUPS).alias("group"))
    concept = F.explode(F.array(F.struct(F.col("group").alias("focal"), F.lit(0.5).alias("mass")), F.struct(F.lit(evidence.THETA).alias("focal"), F.lit(0.5).alias("mass"))))
    return masses(spark, sf).unionByName(e.select("item", concept.alias("m")).select("item", "m.*", F.lit("concept").alias("source")))


def inner_fused(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.fuse(inner_masses(spark, sf), inner_frame(spark, sf))


# Dempster's rule pair by pair over explicit sets, ['*'] for everything.
_SETS = f"""groups AS (SELECT code[2:]::INT % {GROUPS} AS k, list_sort(list(code)) AS codes FROM cats GROUP BY 1),
m1 AS (SELECT item, string_split(focal, '|') AS s, mass FROM cosp UNION ALL SELECT item, ['*'], 1 - sum(mass) FROM cosp GROUP BY 1),
m2 AS (SELECT item, string_split(focal, '|') AS s, mass FROM lexp UNION ALL SELECT item, ['*'], 1 - sum(mass) FROM lexp GROUP BY 1),
m3 AS (SELECT item, codes AS s, 0.5 AS mass FROM e JOIN groups ON item % {GROUPS} = k UNION ALL SELECT item, ['*'], 0.5 FROM e),
m12 AS (SELECT item, CASE WHEN a.s = ['*'] THEN b.s WHEN b.s = ['*'] THEN a.s ELSE list_sort(list_intersect(a.s, b.s)) END AS s, sum(a.mass * b.mass) AS mass FROM m1 a JOIN m2 b USING (item) GROUP BY ALL),
m123 AS (SELECT item, CASE WHEN a.s = ['*'] THEN b.s WHEN b.s = ['*'] THEN a.s ELSE list_sort(list_intersect(a.s, b.s)) END AS s, sum(a.mass * b.mass) AS mass FROM m12 a JOIN m3 b USING (item) GROUP BY ALL),
inner_fused AS (SELECT item, s, mass / sum(mass) OVER (PARTITION BY item) AS mass, 1 - sum(mass) OVER (PARTITION BY item) AS conflict FROM m123 WHERE len(s) > 0)"""
_INNER = f"WITH {_SIMS}, {_PAIRS}, {_COS}, {_paired('cosm', 'cosp')}, {_PROBA}, {_LEX}, {_paired('lexm', 'lexp')}, {_SETS}"
_INNER_IV = """targets AS (SELECT code, [code] AS codes FROM cats UNION ALL SELECT 'g' || k, codes FROM groups UNION ALL SELECT 'root', list(code) FROM cats),
inner_iv AS (SELECT f.item, t.code, any_value(conflict) AS conflict, sum(CASE WHEN t.code = 'root' OR len(list_intersect(s, codes)) = len(s) THEN mass ELSE 0 END) AS bel, sum(CASE WHEN s = ['*'] OR len(list_intersect(s, codes)) > 0 THEN mass ELSE 0 END) AS pl,
 sum(CASE WHEN len(codes) > 1 THEN 0 WHEN s = ['*'] THEN mass / (SELECT count(*) FROM cats) WHEN list_contains(s, t.code) THEN mass / len(s) ELSE 0 END) AS betp FROM inner_fused f, targets t GROUP BY f.item, t.code)"""


@query("d12_inner_fusion", _INNER + f" SELECT item, CASE WHEN len(s) > 2 THEN 'g' || s[1][2:]::INT % {GROUPS} ELSE array_to_string(s, '|') END AS focal, round(mass, {R}) AS mass, round(conflict, {R}) AS conflict FROM inner_fused WHERE mass > 1e-9")
def inner_fusion(spark: SparkSession, sf: str) -> DataFrame:
    f = inner_fused(spark, sf).where("mass > 1e-9")
    return f.select("item", "focal", F.round("mass", R).alias("mass"), F.round("conflict", R).alias("conflict"))


@query("d13_inner_intervals", f"{_INNER}, {_INNER_IV} SELECT item, code, round(bel, {R}) AS bel, round(pl, {R}) AS pl, round(betp, {R}) AS betp FROM inner_iv")
def inner_intervals(spark: SparkSession, sf: str) -> DataFrame:
    i = evidence.intervals(inner_fused(spark, sf), inner_frame(spark, sf))
    return i.select("item", "code", *(F.round(c, R).alias(c) for c in ("bel", "pl", "betp")))


@query("d15_path_beliefs", f"""{_INNER}, {_INNER_IV}, top AS (SELECT item, arg_min(code, (-betp, code)) AS best FROM inner_iv WHERE len(code) < 4 AND code LIKE 'c%' GROUP BY 1)
SELECT item, best, code, round(bel, {R}) AS bel, round(pl, {R}) AS pl FROM top JOIN inner_iv USING (item) WHERE code IN (best, 'g' || best[2:]::INT % {GROUPS}, 'root')""")
def path_beliefs(spark: SparkSession, sf: str) -> DataFrame:
    """Belief and plausibility at each node between the decision and the root."""
    i = evidence.intervals(inner_fused(spark, sf), inner_frame(spark, sf))
    best = evidence.decide(i).select("item", F.col("code").alias("best"))
    nodes = evidence.closure(tree(spark, sf)).select(F.col("code").alias("best"), F.col("ancestor").alias("code"))
    return best.join(nodes, "best").join(i, ["item", "code"]).select("item", "best", "code", F.round("bel", R).alias("bel"), F.round("pl", R).alias("pl"))


@query("d15_best_singletons", f"WITH {_SIMS}, {_PAIRS}, {_COS}, {_paired('cosm', 'cosp')}, {_PROBA}, {_LEX}, {_paired('lexm', 'lexp')}, m AS (SELECT * FROM cosp UNION ALL SELECT * FROM lexp) SELECT item, source, arg_min(focal, (-mass, focal)) AS code, round(max(mass), {R}) AS mass FROM m WHERE NOT contains(focal, '|') GROUP BY ALL")
def best_singletons(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.best_singletons(masses(spark, sf)).withColumn("mass", F.round("mass", R))


@query("d16_frame", "WITH t AS (SELECT 'n' || n_nationkey AS leaf, 'r' || n_regionkey AS parent FROM nation) SELECT leaf AS code, leaf FROM t UNION ALL SELECT parent, leaf FROM t UNION ALL SELECT 'root', leaf FROM t")
def frame_sets(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf, "region").join(n.select(F.substring("parent", 2, 9).cast("int").alias("r_regionkey")).distinct(), "r_regionkey", "left_semi")
    whole = n.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("root").alias("parent")))
    return evidence.Frame.of(whole).descendants(n)


@query("d13_intervals", f"{_BOTH}, {_INTERVALS} SELECT item, code, round(bel, {R}) AS bel, round(pl, {R}) AS pl, round(betp, {R}) AS betp FROM iv")
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    i = evidence.intervals(fused(spark, sf), frame(spark, sf))
    return i.select("item", "code", *(F.round(c, R).alias(c) for c in ("bel", "pl", "betp")))


@query("d14_decision", f"{_BOTH}, {_INTERVALS}, {_DECIDE} SELECT item, code, round(betp, 3) AS confidence, round(bel, 4) AS bel, round(pl, 4) AS pl, round(conflict, 4) AS conflict, pl - bel > 0.3 OR round(conflict, 4) > 0.2 AS needs_clarification FROM best")
def decision(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.decide_fused(fused(spark, sf), frame(spark, sf))


def _judged(spark: SparkSession, sf: str, without: str = "") -> DataFrame:
    truth = table(spark, sf, "embeddings").where("vec_id % 11 <> 5").select(F.col("vec_id").alias("item"), F.concat(F.lit("c"), "label").alias("truth"))
    return evidence.evaluate(evidence.decide_fused(fused(spark, sf, without), frame(spark, sf)), truth)


_JUDGED = f"{_BOTH}, {_INTERVALS}, {_DECIDE}, judged AS (SELECT b.*, t.code AS truth, CASE WHEN t.code IS NULL THEN 'no_truth' WHEN t.code = b.code THEN 'correct' ELSE 'wrong' END AS status FROM best b LEFT JOIN (SELECT * FROM e WHERE item % 11 <> 5) t USING (item))"


@query("c17_truth_join", _JUDGED + " SELECT item, code, truth, status FROM judged")
def truth_join(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("item", "code", "truth", "status")


#: Truth of some items is known as a group only, which a leaf of it meets in the hierarchy alone.
_GROUPED = f"grouped AS (SELECT * REPLACE (CASE WHEN item % 13 = 0 THEN 'g' || truth[2:]::INT % {GROUPS} ELSE truth END AS truth) FROM judged WHERE truth IS NOT NULL)"


def _grouped(judged: DataFrame) -> DataFrame:
    group = F.concat(F.lit("g"), F.substring("truth", 2, 9).cast("int") % GROUPS)
    return judged.where("truth IS NOT NULL").withColumn("truth", F.when(F.col("item") % 13 == 0, group).otherwise(F.col("truth")))


@query("d18_evaluation", _JUDGED + f""", {_GROUPED}, c AS (SELECT code, sum((truth = j.code)::INT) AS tp, count(*) AS got FROM grouped j GROUP BY 1), t AS (SELECT truth AS code, count(*) AS n FROM grouped GROUP BY 1),
f AS (SELECT coalesce(tp, 0) AS tp, coalesce(got, 0) AS got, coalesce(n, 0) AS n FROM c FULL JOIN t USING (code)), l AS (SELECT avg((truth = code OR truth = 'g' || code[2:]::INT % {GROUPS})::INT) AS h, avg(round(bel, 4)) FILTER (round(bel, 4) > 0) AS b, avg(round(pl, 4) - round(bel, 4)) FILTER (round(bel, 4) > 0) AS gap, avg(round(conflict, 4)) FILTER (round(bel, 4) > 0) AS k, avg((pl - bel > 0.3 OR round(conflict, 4) > 0.2)::INT) AS q FROM grouped)
SELECT round(sum(tp) / sum(n), 4) AS accuracy, round(2.0 * sum(tp) / (sum(got) + sum(n)), 4) AS micro_f1, round(avg(2.0 * tp / (got + n)), 4) AS macro_f1, sum(n)::BIGINT AS n, round(any_value(h), 4) AS hierarchical_accuracy, round(any_value(b), 3) AS mean_belief, round(any_value(gap), 3) AS mean_gap, round(any_value(k), 3) AS mean_conflict, round(any_value(q), 4) AS clarification_rate FROM f, l""")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.figures(_grouped(_judged(spark, sf)), evidence.closure(tree(spark, sf)))


@query("d19_worst_types", _JUDGED + " SELECT truth, count(*) AS n, round(avg((code = truth)::INT), 4) AS recall FROM judged WHERE truth IS NOT NULL GROUP BY 1 ORDER BY recall, truth LIMIT 10")
def worst_types(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf).where("truth IS NOT NULL")
    r = j.groupBy("truth").agg(F.count("*").alias("n"), F.round(F.avg((F.col("code") == F.col("truth")).cast("int")), 4).alias("recall"))
    return r.orderBy("recall", "truth").limit(10)


@query("d19_misclassified", _JUDGED + " SELECT item, truth, code, round(betp, 3) AS confidence FROM judged WHERE truth <> code")
def misclassified(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("truth <> code").select("item", "truth", "code", "confidence")


@query("d19_distribution", _JUDGED + " SELECT coalesce(c.code, t.code) AS code, coalesce(predicted, 0) AS predicted, coalesce(actual, 0) AS actual FROM (SELECT code, count(*) AS predicted FROM judged GROUP BY 1) c FULL JOIN (SELECT truth AS code, count(*) AS actual FROM judged WHERE truth IS NOT NULL GROUP BY 1) t USING (code)")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    both = j.select("code", F.lit(1).alias("p"), F.lit(0).alias("a")).unionByName(j.where("truth IS NOT NULL").select(F.col("truth").alias("code"), F.lit(0).alias("p"), F.lit(1).alias("a")))
    return both.groupBy("code").agg(F.sum("p").alias("predicted"), F.sum("a").alias("actual"))


@query("d14_evidence", f"WITH {_SIMS}, {_PAIRS}, {_COS}, {_paired('cosm', 'cosp')}, {_PROBA}, {_LEX}, {_paired('lexm', 'lexp')}, m AS (SELECT * FROM cosp UNION ALL SELECT * FROM lexp), b AS (SELECT item, source, arg_min(focal, (-mass, focal)) AS code, max(mass) AS mass FROM m WHERE NOT contains(focal, '|') GROUP BY ALL) SELECT item, string_agg(source || '=' || code || ':' || printf('%.2f', mass), ', ' ORDER BY source) AS evidence FROM b GROUP BY 1")
def evidence_text(spark: SparkSession, sf: str) -> DataFrame:
    m = masses(spark, sf)
    return evidence.with_evidence(m.select("item").distinct(), m).select("item", "evidence")


_RUNS = {"all": "SELECT * FROM cosp UNION ALL SELECT * FROM lexp", "without lexical": "SELECT * FROM cosp", "without cosine": "SELECT * FROM lexp"}


def _run_sql(run: str) -> str:
    return f"""SELECT * FROM (WITH {_fuse_sql(_RUNS[run])}, {_INTERVALS}, {_DECIDE} SELECT '{run}' AS run, item, b.code, conflict, e.code AS truth FROM best b JOIN e USING (item) WHERE item % 11 <> 5)"""


@query("d20_ablation", f"WITH {_SIMS}, {_PAIRS}, {_COS}, {_paired('cosm', 'cosp')}, {_PROBA}, {_LEX}, {_paired('lexm', 'lexp')}, runs AS ({' UNION ALL '.join(map(_run_sql, _RUNS))}), w AS (SELECT item, (code = truth)::INT AS hit FROM runs WHERE run = 'all') SELECT run, count(*) AS n, sum((code = truth)::INT)::BIGINT AS correct, round(avg(conflict), 3) AS mean_conflict, sum((hit > (code = truth)::INT)::INT)::BIGINT AS lost, sum((hit < (code = truth)::INT)::INT)::BIGINT AS won FROM runs JOIN w USING (item) GROUP BY 1")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    """With all sources and without each one; lost and won against all of them."""
    runs = {"all": "", "without lexical": "lexical", "without cosine": "cosine"}
    found = [_judged(spark, sf, without).where("truth IS NOT NULL").select(F.lit(run).alias("run"), "item", (F.col("code") == F.col("truth")).cast("int").alias("right"), "conflict") for run, without in runs.items()]
    every = found[0].select("item", F.col("right").alias("hit"))
    both = reduce(DataFrame.unionByName, found).join(every, "item")
    return both.groupBy("run").agg(F.count("*").alias("n"), F.sum("right").alias("correct"), F.round(F.avg("conflict"), 3).alias("mean_conflict"), F.count_if(F.col("hit") > F.col("right")).alias("lost"), F.count_if(F.col("hit") < F.col("right")).alias("won"))


@query("c14_name_match", """WITH c AS (SELECT p_type || ' Kind' AS label, p_type AS p_type, row_number() OVER (ORDER BY p_type) AS place FROM (SELECT DISTINCT p_type FROM part)),
i AS (SELECT p_partkey AS item, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) || '_kind' WHEN 1 THEN lower(p_type[1:3]) || 'k' WHEN 2 THEN 'the_' || lower(p_type) || '_of_a_kind' ELSE p_name END AS name FROM part),
m AS (SELECT item, CASE WHEN trim(lower(replace(name, '_', ' '))) = lower(label) THEN 0.7 WHEN replace(lower(replace(name, '_', ' ')), ' ', '') = lower(p_type[1:3]) || 'k' THEN 0.5
  WHEN list_has_all(string_split(lower(replace(name, '_', ' ')), ' '), string_split(lower(label), ' ')) THEN 0.3 END AS mass, place FROM i, c),
b AS (SELECT item, arg_min(place, (-mass, place)) AS place, max(mass) AS mass FROM m WHERE mass IS NOT NULL GROUP BY 1)
SELECT item, 'k' || place AS focal, mass FROM b UNION ALL SELECT i.item, '*', round(1 - coalesce(mass, 0), 6) FROM i LEFT JOIN b USING (item)""")
def name_match(spark: SparkSession, sf: str) -> DataFrame:
    """Names that match a label exactly, by its abbreviation, by all its words, or not at all."""
    types = table(spark, sf, "part").select("p_type").distinct().withColumn("place", F.row_number().over(Window.orderBy("p_type")))
    short = F.concat(F.lower(F.substring("p_type", 1, 3)), F.lit("k"))
    cats = types.select(F.concat(F.lower("p_type"), F.lit(" kind")).alias("label"), "place", F.concat(F.lit("k"), "place").alias("code"), short.alias("abbrev"))
    k, kind = F.col("p_partkey") % 4, F.lower("p_type")
    name = F.when(k == 0, F.concat(kind, F.lit("_kind"))).when(k == 1, short).when(k == 2, F.concat(F.lit("the_"), kind, F.lit("_of_a_kind"))).otherwise(F.col("p_name"))
    return _shown(evidence.from_names(table(spark, sf, "part").select(F.col("p_partkey").alias("item"), name.alias("name")), cats))


@query("d16_closure", """WITH RECURSIVE t AS (SELECT 'n' || n_nationkey AS code, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'root', NULL UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
c AS (SELECT code, code AS ancestor FROM t UNION ALL SELECT c.code, t.parent FROM c JOIN t ON c.ancestor = t.code WHERE t.parent IS NOT NULL) SELECT code, ancestor FROM c""")
def closure(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("root").alias("parent"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("code"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    root = spark.createDataFrame([("root", None)], "code string, parent string")
    return evidence.closure(n.unionByName(r).unionByName(s).unionByName(root))
