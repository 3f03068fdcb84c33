"""The fact log: entity, attribute, value, transaction, assert or retract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Attributes that come first, and columns that are never facts. Fixed values.
FIRST_ATTRIBUTES = ("peer", "title", "kind", "leaf", "agent_focus")
NEVER_FACTS = ("id", "product_id", "e", "tx_id", "event_id", "ts_ns", "updated_ns", "epoch_hour")


def melt(products: DataFrame, entity: str) -> DataFrame:
    """(e, a, v, place) of wide rows: scalar columns that aren't null, ids or private.

    place orders the attributes: the fixed ones first, then the others as they
    stand in the table.
    """
    scalar = [n for n, kind in products.dtypes if n != entity and n not in NEVER_FACTS and not n.startswith("_") and not kind.startswith(("array", "map", "struct"))]
    order = [a for a in FIRST_ATTRIBUTES if a in scalar] + [a for a in scalar if a not in FIRST_ATTRIBUTES]
    wide = products.select(F.col(entity).alias("e"), *(F.col(f"`{a}`").cast("string").alias(a) for a in order))
    place = F.create_map(*(x for i, a in enumerate(order) for x in (F.lit(a), F.lit(i))))
    return wide.unpivot("e", [F.col(f"`{a}`") for a in order], "a", "v").where("v IS NOT NULL").withColumn("place", place[F.col("a")])


def expand(facts: DataFrame, requires: DataFrame) -> DataFrame:
    """Adds aspect.<id> = declared for what an entity's kind requires and it lacks.

    `requires` has kind and aspect; an entity's kind is its fact of that name.
    """
    kinds = facts.where("a = 'kind'").select("e", F.col("v").alias("kind"))
    wanted = kinds.join(requires, "kind").select("e", F.concat(F.lit("aspect."), F.col("aspect")).alias("a"), F.lit("declared").alias("v")).distinct()
    missing = wanted.join(facts.select("e", "a").distinct(), ["e", "a"], "left_anti")
    return facts.select("e", "a", "v").unionByName(missing)


def current(facts: DataFrame) -> DataFrame:
    """The latest fact of each attribute, if it asserts. Ties: ts_ns, then op, then v."""
    by = Window.partitionBy("e", "a").orderBy(*(F.col(c).desc() for c in ("t", "ts_ns", "op", "v")))
    return facts.where("a <> ''").withColumn("_place", F.row_number().over(by)).where("_place = 1 AND op").drop("_place")


def project(facts: DataFrame, attributes: list[str]) -> DataFrame:
    """One wide row for each entity with a live fact; tx_id is the latest live transaction."""
    live = current(facts)
    values = [F.max(F.when(F.col("a") == a, F.col("v"))).alias(a) for a in attributes]
    return live.groupBy("e").agg(*values, F.max("t").alias("tx_id"))


def project_maps(facts: DataFrame) -> DataFrame:
    """Like project(), for attributes that aren't known beforehand."""
    live = current(facts)
    return live.groupBy("e").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("a", "v")))).alias("facts"), F.max("t").alias("tx_id"))


RUN = r"^run\.([^/]+)/([^.]+)\.(.+)$"


def runs(facts: DataFrame, facets: list[str]) -> DataFrame:
    """Retained runs from attributes run.{flow}/{id}.{facet}, a column for each facet."""
    found = current(facts).where(F.col("a").rlike(RUN)).select("e", *(F.regexp_extract("a", RUN, i).alias(n) for i, n in enumerate(("flow", "run", "facet"), 1)), "v")
    return found.groupBy("e", "flow", "run").agg(*(F.max(F.when(F.col("facet") == f, F.col("v"))).alias(f) for f in facets))


def run_facts(runs: DataFrame, store_prefix: str) -> DataFrame:
    """Facts of run rows (e, flow, run, status, artifact): latest_* and run-qualified.

    Fails closed: runs whose artifact isn't in the store make no facts.
    """
    stored = runs.where(F.coalesce(F.col("artifact").startswith(store_prefix), F.lit(False)))
    name = F.concat(F.lit("run."), F.col("flow"), F.lit("/"), F.col("run"), F.lit("."))
    long = stored.unpivot(["e", "flow", "run", "t"], ["status", "artifact"], "facet", "v")
    qualified = long.select("e", F.concat(name, F.col("facet")).alias("a"), "v", "t")
    newest = Window.partitionBy("e", "flow").orderBy(F.col("t").desc())
    latest = stored.withColumn("_place", F.row_number().over(newest)).where("_place = 1")
    latest = latest.unpivot(["e", "flow", "run", "t"], ["status", "artifact"], "facet", "v").select("e", F.concat(F.lit("latest_"), F.col("flow"), F.lit("_"), F.col("facet")).alias("a"), "v", "t")
    return qualified.unionByName(latest)


def with_defaults(rows: DataFrame, now_ns: int) -> DataFrame:
    """Transactions to append: time, kind and hour where they are missing.

    The hour is that of the UUIDv7, else that of the time.
    """
    from varve.functions import keys

    out = rows.withColumn("ts_ns", F.coalesce("ts_ns", F.lit(now_ns))).withColumn("kind", F.coalesce("kind", F.lit("updated")))
    return out.withColumn("epoch_hour", F.coalesce(keys.uuid7_hour("tx_id"), keys.epoch_hour("ts_ns")))


def newest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest n rows, oldest first."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n).orderBy(*order)


def integrity(specs: DataFrame, aspects: DataFrame, products: DataFrame) -> DataFrame:
    """(problem, id): required aspects that don't exist, ids that are both aspect and product."""
    missing = specs.select(F.col("aspect").alias("id")).distinct().join(aspects.select("id"), "id", "left_anti").select(F.lit("missing aspect").alias("problem"), "id")
    both = aspects.select("id").join(products.select("id"), "id", "left_semi").select(F.lit("aspect and product").alias("problem"), "id")
    return missing.unionByName(both)


def operations(tx: DataFrame, *parts: DataFrame, key: str = "tx_id") -> DataFrame:
    """tx with each part joined by transaction; parts are left-joined."""
    return reduce(lambda left, right: left.join(right, key, "left"), parts, tx)


def definition_facts(aspects: DataFrame, specs: DataFrame) -> DataFrame:
    """(a, v): titles and intents of aspects (id, title, intent), and what each spec (id, requires) requires.

    Rows without an id, and empty titles or intents, say nothing; of repeated ones the largest value counts.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    named = aspects.where(text("id") != "")
    parts = [named.where(text(c) != "").select(F.concat(F.lit("def."), "id", F.lit(f".{c}")).alias("a"), F.col(c).alias("v")) for c in ("title", "intent")]
    needs = specs.where(text("id") != "").select("id", F.explode("requires").alias("aspect"))
    parts.append(needs.select(F.concat(F.lit("spec."), "id", F.lit(".requires."), "aspect").alias("a"), F.lit("true").alias("v")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("a").agg(F.max("v").alias("v"))
