"""Claims on queues: floors, budgets, leases, supersession, catalogue checks, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live(requests: DataFrame, now: int) -> DataFrame:
    """Accepted requests whose window holds `now`; a bound of 0 or null is open."""
    begun, ends = F.coalesce("valid_from", F.lit(0)), F.coalesce("valid_until", F.lit(0))
    return requests.where((begun <= now) & ((ends == 0) | (ends > now)) & (F.col("state") == "accepted"))


def floors(requests: DataFrame) -> DataFrame:
    """The largest floor of each queue over live requests; a request's own floor goes before its footprint, that before its guarantee."""
    return requests.groupBy("queue").agg(F.max(F.coalesce("floor", "footprint", "guaranteed")).alias("floor"))


def budgets(leaves: DataFrame, sep: str = ".") -> DataFrame:
    """Guarantees summed at every ancestor: leaves (queue, guaranteed, floor) -> (node, guaranteed, leaves)."""
    parts = F.split("queue", F.concat(F.lit("\\"), F.lit(sep)) if sep == "." else sep)
    own = F.greatest(F.coalesce("guaranteed", F.lit(0)), F.coalesce("floor", F.lit(0)))
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    return leaves.select(F.explode(ancestors).alias("node"), own.alias("g")).groupBy("node").agg(F.sum("g").alias("guaranteed"), F.count("*").alias("leaves"))


def over_budget(budgets: DataFrame, limits: DataFrame) -> DataFrame:
    """Nodes whose guarantees pass their limit, with a sentence."""
    text = F.format_string("%s: guaranteed %d exceeds %d", "node", "guaranteed", "max")
    return budgets.join(limits, "node").where("guaranteed > max").select("node", "guaranteed", "max", text.alias("problem"))


def over_commit(held: DataFrame, wanted: DataFrame, limits: DataFrame) -> DataFrame:
    """Verdict of each wanted leaf: unknown, refused (held + wanted above max) or fine."""
    sums = held.groupBy("leaf").agg(F.sum("n").alias("held"))
    w = wanted.groupBy("leaf").agg(F.sum("n").alias("wanted")).join(sums, "leaf", "left").join(limits, "leaf", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    verdict = F.when(F.col("max").isNull(), "unknown").when(F.col("held") + F.col("wanted") > F.col("max"), "refused").otherwise("fine")
    return w.select("leaf", "held", "wanted", "max", verdict.alias("verdict"))


def lease_state(leases: DataFrame, now: int) -> DataFrame:
    """alive, released, or lapsed (past the horizon, or without a heartbeat for the ttl)."""
    lapsed = (F.lit(now) >= F.col("horizon")) | (F.lit(now) - F.col("heartbeat") >= F.col("ttl"))
    return leases.withColumn("state", F.when(F.col("released"), "released").when(lapsed, "lapsed").otherwise("alive"))


def superseded(requests: DataFrame) -> DataFrame:
    """Adds retired: a later request of the same peer shares a key, or names this one.

    `requests` has peer, id, at, keys (array) and supersedes. Of a repeated id
    the latest row counts, of equal times the largest one.
    """
    columns = ["at", *(c for c in requests.columns if c not in ("id", "at"))]
    once = requests.groupBy("id").agg(F.max(F.struct(*columns)).alias("_last")).select("id", "_last.*").select(*requests.columns)
    key = once.select("peer", "id", "at", F.explode("keys").alias("key"))
    newer = F.lead("id").over(Window.partitionBy("peer", "key").orderBy("at", "id"))
    shared = key.withColumn("newer", newer).groupBy("id").agg(F.max(F.col("newer").isNotNull()).alias("shared"))
    named = once.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"), F.lit(True).alias("named")).distinct()
    out = once.join(shared, "id", "left").join(named, "id", "left")
    return out.withColumn("retired", F.coalesce("shared", F.lit(False)) | F.coalesce("named", F.lit(False))).drop("shared", "named")


def enabled_since(log: DataFrame, key: str, at: str) -> DataFrame:
    """Adds enabled_since: the time a run of enabled rows began; null while disabled."""
    order = Window.partitionBy(key).orderBy(at)
    begins = F.col("enabled") & ~F.coalesce(F.lag("enabled").over(order), F.lit(False))
    stamp = F.last(F.when(begins, F.col(at)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("enabled_since", F.when(F.col("enabled"), stamp))


def retained(snapshots: DataFrame, key: str, at: str, keep: int, content: str) -> DataFrame:
    """The newest `keep` snapshots of each key, leaving out those equal to the one before."""
    changed = F.col(content).eqNullSafe(F.lag(content).over(Window.partitionBy(key).orderBy(at)))
    fresh = snapshots.withColumn("_same", changed & F.lag(at).over(Window.partitionBy(key).orderBy(at)).isNotNull()).where("NOT _same").drop("_same")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc()))).where(F.col("_n") <= keep).drop("_n")


def catalogue_problems(entries: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, problems): unknown predecessors, claims above a leaf's limit, repeated ids; joined by '; '."""
    known = entries.select(F.col("id").alias("before")).distinct()
    after = entries.select("id", F.explode("after").alias("before"))
    missing = after.join(known, "before", "left_anti").select("id", F.concat(F.lit("unknown predecessor "), "before").alias("problem"))
    claims = entries.groupBy("id", "leaf").agg(F.sum("n").alias("n")).join(limits, "leaf")
    over = claims.where("n > max").select("id", F.format_string("claims %d of %s, limit %d", "n", "leaf", "max").alias("problem"))
    twice = entries.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    found = missing.unionByName(over).unionByName(twice).distinct()
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems"))


def snapshot_sync(previous: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Whole replacement: incoming rows win, absent ones stay, paused."""
    p, i = previous.select(key, *columns).withColumn("_p", F.lit(True)), incoming.select(key, *(F.col(c).alias(f"_{c}") for c in columns)).withColumn("_i", F.lit(True))
    both = p.join(i, key, "full_outer")
    there = F.coalesce("_i", F.lit(False))
    state = F.when(~there, "paused").when(F.col("_p").isNull(), "new").otherwise("kept")
    return both.select(key, *(F.when(there, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns), state.alias("state"))


def merge_hints(own: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Peers' rows for keys that are missing; own rows never change, the first peer wins."""
    first = hints.join(own.select(key), key, "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("peer"))).where("_n = 1").drop("_n")
    return own.withColumn("peer", F.lit(None).cast("string")).unionByName(first)


def capacity_gate(leaves: DataFrame, limits: DataFrame, capacity: int | None, sep: str = ".") -> DataFrame:
    """One row with the reason why guarantees may not be applied, or null.

    Parents whose children pass their limit come first, by name; then the sum
    over all leaves against the capacity, unless that is unknown. leaves:
    (queue, guaranteed, floor); limits: (node, max).
    """
    sums = budgets(leaves, sep)
    parents = sums.join(leaves.select(F.col("queue").alias("node")), "node", "left_anti").join(limits, "node").where("guaranteed > max")
    over = parents.agg(F.array_sort(F.collect_list(F.struct("node", F.format_string("%s: children guaranteed %d > max %d", "node", "guaranteed", "max").alias("text")))).alias("_over"))
    own = F.greatest(F.coalesce("guaranteed", F.lit(0)), F.coalesce("floor", F.lit(0)))
    total = leaves.agg(F.coalesce(F.sum(own), F.lit(0)).alias("total"))
    most = F.lit(capacity).cast("long")
    parts = F.concat(F.transform("_over", lambda x: x["text"]), F.when(F.col("total") > most, F.array(F.format_string("leaf guaranteed %d > capacity %d", "total", most))).otherwise(F.array().cast("array<string>")))
    reason = F.array_join(parts, "; ")
    return over.crossJoin(total).select("total", F.when(reason != "", reason).alias("reason"))


def pruned(records: DataFrame, before: int, terminal: tuple[str, ...], state: str = "state", at: str = "at") -> DataFrame:
    """What stays: terminal records from `before` on, and every record that isn't terminal, however old."""
    return records.where(~F.coalesce(F.col(state).isin(*terminal) & (F.col(at) < before), F.lit(False)))


#: How the predecessors of an entry may be read. Fixed values.
AFTER_MODES = ("all", "any")


def entry_rules(entries: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, state, problems) of entries (id, kind, cron, after, after_mode, claims (leaf, n), enabled), problems joined by '; ' in order of the rules.

    What an entry says by itself is one pass of conditions; leaves and
    predecessors are looked up by joins. Entries without an id are told apart
    by their row.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = entries.withColumn("_row", F.monotonically_increasing_id())
    many, mode = F.coalesce(F.size("after"), F.lit(0)) > 0, text("after_mode")
    own = F.array(
        F.when(text("id") == "", "01 id is required"),
        F.when(text("kind") == "", "02 kind is required"),
        F.when((mode != "") & ~mode.isin(*AFTER_MODES), F.concat(F.lit("06 unknown after_mode "), mode)),
        F.when((mode != "") & ~many, "07 after_mode without after"),
        F.when((text("cron") != "") & many & (mode == ""), "08 both cron and after without after_mode"),
    )
    claims = rows.select("_row", F.explode("claims").alias("c")).select("_row", text("c.leaf").alias("leaf"), F.coalesce("c.n", F.lit(0)).alias("n"))
    plain = claims.select("_row", F.explode(F.array(F.when(F.col("leaf") == "", "03 claim without a leaf"), F.when((F.col("leaf") != "") & (F.col("n") < 0), F.concat(F.lit("03 claim "), "leaf", F.lit(": negative"))))).alias("problem"))
    sums = claims.where("leaf <> ''").groupBy("_row", "leaf").agg(F.sum("n").alias("n")).join(limits, "leaf", "left")
    over = sums.select("_row", F.when(F.col("max").isNull(), F.concat(F.lit("04 claim on unknown leaf "), "leaf")).when(F.col("n") > F.col("max"), F.format_string("04 claim %d on %s exceeds %d", "n", "leaf", "max")).alias("problem"))
    known = rows.select(F.col("id").alias("before")).distinct()
    missing = rows.select("_row", F.explode("after").alias("before")).join(known, "before", "left_anti").select("_row", F.concat(F.lit("05 no such predecessor "), "before").alias("problem"))
    found = rows.select("_row", F.explode(own).alias("problem")).unionByName(plain).unionByName(over).unionByName(missing).where("problem IS NOT NULL")
    each = found.groupBy("_row").agg(F.array_sort(F.collect_set("problem")).alias("_found"))
    texts = F.array_join(F.transform("_found", lambda x: F.substring(x, 4, 1_000)), "; ")
    state = F.when(F.col("_found").isNotNull(), "error").when(F.coalesce("enabled", F.lit(False)), "materialized").otherwise("paused")
    return rows.join(each, "_row", "left").select("id", state.alias("state"), F.coalesce(texts, F.lit("")).alias("problems"))
