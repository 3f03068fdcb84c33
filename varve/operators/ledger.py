"""Forecast ledger: corrections folded in, Brier score by cell, shrunk trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pseudo-count and prior of trust, and the risk of who has no score yet. Fixed values.
PSEUDO, PRIOR, UNKNOWN_RISK = 2.0, 0.5, 0.5
#: p of a claim that names none, by verdict. Fixed values.
DEFAULT_P = {"satisfied": 0.9, "unverified": 0.5, "ill_posed": 0.5}
#: States of a fleet's workloads, the most severe first. Fixed values.
SEVERITY = ("failing", "running", "resuming", "starting", "accepted", "new", "unknown", "completing", "rejected", "failed", "completed", "missing")
#: The channel that a missed slot of the backlog asks for, from that slot on. Fixed values.
CHANNELS = {0: "none", 1: "log", 3: "agenda", 5: "reminder", 6: "briefing", 9: "discussion"}


def folded(log: DataFrame) -> DataFrame:
    """Observations with their last correction; `log` has id, seq, outcome, is_correction.

    Of a repeated observation the last one counts, and a correction only after
    it; the last one wins. Plain aggregation, since maxima by sequence are all
    that is needed.
    """
    columns = ["seq", *(c for c in log.columns if c not in ("id", "seq"))]
    seen = log.where("NOT is_correction").groupBy("id").agg(F.max(F.struct(*columns)).alias("_last")).select("id", "_last.*").select(*log.columns)
    fixes = log.where("is_correction").select("id", F.col("seq").alias("fix_seq"), F.col("outcome").alias("fix"))
    last = fixes.join(seen.select("id", "seq"), "id").where("fix_seq > seq").groupBy("id").agg(F.max(F.struct("fix_seq", "fix")).alias("last"))
    out = seen.join(last, "id", "left")
    return out.withColumn("outcome", F.when(F.col("last").isNotNull(), F.col("last.fix")).otherwise(F.col("outcome"))).drop("last", "is_correction")


def digits(x: Column) -> Column:
    """Four digits; ties aren't left to the last bit of a sum."""
    return F.round(F.round(x, 10), 4)


def squared_error() -> Column:
    return F.pow(F.col("p") - F.col("outcome").cast("int"), F.lit(2))


def brier(observations: DataFrame, cell: list[str]) -> DataFrame:
    """n, resolved and Brier score (4 digits; null if none is resolved) of each cell."""
    resolved = F.count("outcome")
    return observations.groupBy(*cell).agg(F.count("*").alias("n"), resolved.alias("resolved"), digits(F.avg(squared_error())).alias("brier"))


def report(observations: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Brier report by several axes in one pass, with grouping sets; `axis` names each."""
    columns = sorted({c for cell in axes.values() for c in cell})
    sets = [[F.col(c) for c in cell] for cell in axes.values()]
    marks = F.grouping_id(*columns)
    out = observations.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.count("outcome").alias("resolved"), digits(F.avg(squared_error())).alias("brier"), marks.alias("_set"))
    axis = F.lit(None)
    for name, cell in axes.items():
        axis = F.when(F.col("_set") == sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cell), name).otherwise(axis)
    return out.select(axis.alias("axis"), *columns, "n", "resolved", "brier")


def trust(scores: DataFrame) -> DataFrame:
    """Adds alpha (the score shrunk to the prior) and risk to a Brier table."""
    n = F.col("resolved")
    alpha = F.when(F.col("brier").isNull(), PRIOR).otherwise(n / (n + PSEUDO) * (1 - F.col("brier")) + PSEUDO / (n + PSEUDO) * PRIOR)
    return scores.withColumn("alpha", digits(alpha)).withColumn("risk", F.coalesce("brier", F.lit(UNKNOWN_RISK)))


def resolve_open(observations: DataFrame, facts: DataFrame, window_us: int) -> DataFrame:
    """Corrections for unresolved forecasts whose proposition was settled within the window after them.

    `facts` has proposition, outcome, us. A forecast takes the first fact in time.
    """
    unresolved = observations.where("outcome IS NULL").select("id", "proposition", F.col("us").alias("claimed"))
    due = unresolved.join(facts.select("proposition", F.col("outcome").alias("truth"), F.col("us").alias("settled")), "proposition")
    due = due.where((F.col("settled") >= F.col("claimed")) & (F.col("settled") - F.col("claimed") <= window_us))
    return due.groupBy("id").agg(F.min(F.struct("settled", "truth")).alias("first")).select("id", F.col("first.truth").alias("outcome"), F.col("first.settled").alias("us"))


def claims(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """A claim from a state where its observer isn't well posed resolves to false.

    `allowed` has observer and state; observers that it doesn't name may
    claim from anywhere. p falls back on the verdict's default.
    """
    named = allowed.select("observer").distinct().withColumn("_named", F.lit(True))
    pairs = allowed.select("observer", "state").distinct().withColumn("_allowed", F.lit(True))
    joined = df.join(named, "observer", "left").join(pairs, ["observer", "state"], "left")
    ill = F.col("_named").isNotNull() & F.col("_allowed").isNull()
    verdict = F.when(ill, "ill_posed").when(F.col("truth"), "satisfied").otherwise("unverified")
    default = F.create_map(*(F.lit(x) for pair in DEFAULT_P.items() for x in pair))
    out = joined.withColumn("verdict", verdict).withColumn("outcome", ~ill & F.col("truth"))
    return out.withColumn("p", F.coalesce("p", default[F.col("verdict")])).drop("_named", "_allowed")


def worst_state(states: DataFrame, group: str, severity: list[str]) -> DataFrame:
    """The most severe state of each fleet; states not in the order count as unknown."""
    rank = F.create_map(*(x for i, s in enumerate(severity) for x in (F.lit(s), F.lit(i))))
    known = F.lower(F.coalesce("state", F.lit("unknown")))
    known = F.when(known.isin(severity), known).otherwise("unknown")
    return states.withColumn("_state", known).groupBy(group).agg(F.min_by("_state", F.coalesce(rank[F.col("_state")], F.lit(len(severity)))).alias("state"))


def illegal_transitions(events: DataFrame, legal: list[tuple[str, str]], key: str, order: list[str]) -> DataFrame:
    """Steps of each machine that aren't edges of its graph."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    edges = events.sparkSession.createDataFrame(legal, "before string, state string")
    steps = events.withColumn("before", before).where("before IS NOT NULL AND before <> state")
    return steps.join(F.broadcast(edges), ["before", "state"], "left_anti")


def upkeep(runs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Verdict of each run: the checks that are off, nominal or not."""
    off = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    return runs.withColumn("off", off).withColumn("verdict", F.when(~F.col("is_upkeep"), "not_upkeep").when(F.size("off") > 0, "off_nominal").otherwise("nominal"))


def dwells(events: DataFrame, key: str, time: str, order: list[str], holding: list[str], terminals: list[str]) -> DataFrame:
    """(key, state, since, until, steps, kind, problem): each stay of a machine in one state, without a gap.

    until is null for the stay a machine is in at the end. kind is holding,
    terminal or passing; a terminal state that is left, and a holding one at
    the end (which isn't done), are problems.
    """
    by = Window.partitionBy(key).orderBy(*order)
    began = F.coalesce((F.col("state") != F.lag("state").over(by)).cast("int"), F.lit(1))
    island = events.withColumn("_began", began).withColumn("_island", F.sum("_began").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    stays = island.groupBy(key, "_island").agg(F.first("state").alias("state"), F.min(time).alias("since"), F.count("*").alias("steps"))
    after = Window.partitionBy(key).orderBy("_island")
    out = stays.withColumn("until", F.lead("since").over(after)).withColumn("last", F.lead("_island").over(after).isNull())
    kind = F.when(F.col("state").isin(holding), "holding").when(F.col("state").isin(terminals), "terminal").otherwise("passing")
    problem = F.when((kind == "terminal") & ~F.col("last"), "left a terminal state").when((kind == "holding") & F.col("last"), "held, not done")
    return out.select(key, "state", "since", "until", "steps", kind.alias("kind"), problem.alias("problem"))


def backlog(entries: DataFrame) -> DataFrame:
    """(item, slot, at, deepest, channel, open): of (item, slot, at, ok) the latest entry, and how deep the misses go.

    A later ok resolves an item: only misses after its last ok count. Of
    entries at one time the one of the larger slot is the later. The deepest
    open miss selects the channel.
    """
    when = F.struct("at", "slot")
    ok = F.coalesce("ok", F.lit(False))
    each = entries.groupBy("item").agg(F.max_by("slot", when).alias("slot"), F.max("at").alias("at"), F.max(F.when(ok, when)).alias("_ok"))
    missed = entries.where(~ok).join(each.select("item", "_ok"), "item").where(F.col("_ok").isNull() | (when > F.col("_ok")))
    deep = missed.groupBy("item").agg(F.max("slot").alias("deepest"))
    channel = F.lit("none")
    for slot, name in CHANNELS.items():
        channel = F.when(F.col("deepest") >= slot, name).otherwise(channel)
    out = each.join(deep, "item", "left").withColumn("open", F.col("deepest").isNotNull())
    return out.select("item", "slot", "at", "deepest", F.when(F.col("open"), channel).otherwise("none").alias("channel"), "open")


def method_forecasts(observations: DataFrame, allowed: DataFrame) -> DataFrame:
    """(state, observer, n, resolved, brier, alpha, risk) of every observer in each state it may claim from; without a record it is uncalibrated."""
    scores = brier(observations, ["observer", "state"])
    both = allowed.select("observer", "state").distinct().join(scores, ["observer", "state"], "left").na.fill(0, ["n", "resolved"])
    return trust(both).select("state", "observer", "n", "resolved", "brier", "alpha", "risk")
