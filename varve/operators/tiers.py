"""Hot and settled tiers: one view, reconciliation, settling and dropping.

Tiers are tables with the same columns and an hour column. Hours are few
against rows, so sets of hours are aggregated first; they are broadcast by
Spark where they are small and shuffled where they aren't.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from varve.functions.keys import HOURS_PER_WEEK
from varve.session import shared_dir, written

HOUR = "epoch_hour"


def union_view(hot: DataFrame, settled: DataFrame | None = None, hour: str = HOUR) -> DataFrame:
    """Hot rows and the settled rows of hours that aren't hot.

    The hour is never null (checked on landing), so an anti join says the
    same as NOT IN. Columns that one tier lacks are null there.
    """
    if settled is None:
        return hot
    rest = settled.join(hot.select(hour).distinct(), hour, "left_anti")
    return hot.unionByName(rest, allowMissingColumns=True)


def hour_counts(df: DataFrame, hour: str = HOUR) -> DataFrame:
    return df.groupBy(hour).agg(F.count("*").alias("n"))


def reconcile(hot: DataFrame, settled: DataFrame, now_hour: int, hour: str = HOUR) -> DataFrame:
    """Each hour of either tier with both counts and what may be done.

    live: not over yet; analog: not settled; refuse: settled short; drop: both
    equal; extra: settled has more; settled: no longer hot.
    """
    both = hour_counts(hot, hour).withColumnRenamed("n", "hot_n").join(hour_counts(settled, hour).withColumnRenamed("n", "settled_n"), hour, "full_outer")
    hot_n, settled_n = F.coalesce("hot_n", F.lit(0)), F.coalesce("settled_n", F.lit(0))
    verdict = (
        F.when(F.col(hour) >= now_hour, "live")
        .when(hot_n == 0, "settled")
        .when(settled_n == 0, "analog")
        .when(settled_n < hot_n, "refuse")
        .when(settled_n > hot_n, "extra")
        .otherwise("drop")
    )
    return both.select(hour, hot_n.alias("hot_n"), settled_n.alias("settled_n"), verdict.alias("verdict"))


def settle_state(hot: DataFrame, verified: DataFrame, hour: str = HOUR) -> DataFrame:
    """Per day: hours present in the hot tier, those verified, and whether the day may go.

    `verified` has the hour and the rows verified; a day goes only if every
    present hour still has exactly that many rows, so rows that came late
    open it again.
    """
    present = hour_counts(hot, hour).join(verified.select(hour, F.col("rows").alias("verified_rows")), hour, "left")
    fine = F.coalesce(F.col("n") == F.col("verified_rows"), F.lit(False))
    day = F.expr(f"{hour} div 24").alias("day")
    return present.groupBy(day).agg(F.count("*").alias("present"), F.sum(fine.cast("long")).alias("verified"), F.min(fine).alias("droppable"))


def closed(df: DataFrame, now_hour: int, hour: str = HOUR) -> DataFrame:
    return df.where(F.col(hour) < now_hour)


def upkeep_plan(spark: SparkSession, tables: DataFrame, now_hour: int) -> DataFrame:
    """Per table the range to add (the week after next) and the settle bound.

    Everything before the bound settles, not just one week, so a missed run
    leaves nothing behind.
    """
    start = now_hour // HOURS_PER_WEEK * HOURS_PER_WEEK
    return tables.select(
        "table", F.lit(start + HOURS_PER_WEEK).alias("add_from"), F.lit(start + 2 * HOURS_PER_WEEK).alias("add_to"), F.lit(start - 4 * HOURS_PER_WEEK).alias("settle_before"),
        F.concat(F.lit("ADD RANGE "), F.lit(start + HOURS_PER_WEEK), F.lit(" TO "), F.lit(start + 2 * HOURS_PER_WEEK), F.lit(" OF "), F.col("table")).alias("statement"),
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order` (UPSERT: last write wins), with partial aggregation."""
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*order)).alias("_last")
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(last).select("_last.*")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`current` with `changes` landed by key; later in `order` wins, changes win ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*order, "_new"]).drop("_new")


#: Hours that are named in a filter; more are told by the first and last one and a join.
HOURS_NAMED = 10_000


def in_hours(df: DataFrame, hours: DataFrame, hour: str = HOUR) -> DataFrame:
    """The rows of `hours`, as a filter on the partition column, so only the folders of these hours are read.

    Hours are few (8,766 a year), so their numbers may go through the driver;
    where more than HOURS_NAMED are asked for, a range prunes and a join decides.
    """
    distinct = hours.select(hour).distinct()
    named = [r[0] for r in distinct.limit(HOURS_NAMED + 1).collect()]
    unnamed = F.col(hour).isNull() if None in named or len(named) > HOURS_NAMED else F.lit(False)
    if len(named) <= HOURS_NAMED:
        return df.where(F.col(hour).isin([h for h in named if h is not None]) | unnamed)
    ends = hours.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).first()
    wanted = distinct.withColumnRenamed(hour, "_wanted")
    return df.where(F.col(hour).between(ends.a, ends.b) | unnamed).join(wanted, F.col(hour).eqNullSafe(F.col("_wanted")), "left_semi")


def write_hours(df: DataFrame, path: str, sort: list[str], hour: str = HOUR) -> None:
    """Replace the hours that `df` has, and only those; the same again changes nothing.

    Rows are rebalanced by hour: Spark joins small hours into one task and
    splits a large one over several. Files are sorted, so footers bound what
    they hold. Hours are staged and moved once all are written, so `df` may
    read from `path`.
    """
    dealt = df.hint("rebalance", hour).sortWithinPartitions(hour, *sort)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(hour).parquet(path)


def upsert_hours(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: list[str], hour: str = HOUR) -> None:
    """Land changes in a written tier whose keys never change their hour: only touched hours are read and rewritten.

    A folder that isn't there yet counts as empty. Landing the same changes
    again changes nothing. Keys that may change their hour: see `keyed`.
    """
    current = in_hours(_read(spark, path, changes.schema), changes, hour)
    write_hours(upsert(current, changes, keys, order), path, keys, hour)


_STATE = "{0} long, hot long, rows long, written long, verified boolean, run long, step int, staged string"


def state_of(spark: SparkSession, path: str, hour: str = HOUR) -> DataFrame:
    """The newest state of each hour that was ever settled; none where nothing was written yet.

    hot: rows of the hot tier that the settled ones cover (0 once removed);
    rows: what the settled hour should have, written: what it has. Steps of a
    run: 0 due, 1 settled, 2 removed from the hot tier.
    """
    return latest(_read(spark, path, _STATE.format(hour)), [hour], ["run", "step"])


def _read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merged(settled: DataFrame, hot: DataFrame, keys: list[str] | None) -> DataFrame:
    """All rows of both, each key once; a hot row replaces the settled one of its key.

    Without keys the row itself is the key, and a row that one side has
    several times stays as often as the side with more of them has it.
    """
    if keys is None:
        columns = [F.col(f"`{c}`") for c in hot.columns]
        sides = [df.groupBy(*columns).agg(F.count("*").alias("_n")) for df in (settled.select(*columns), hot)]
        times = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.max("_n").alias("_n"))
        return times.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    return upsert(settled.withColumn("_side", F.lit(0)), hot.withColumn("_side", F.lit(1)), keys, ["_side"]).drop("_side")


def settle_hours(
    spark: SparkSession, hot: DataFrame, path: str, now_hour: int, sort: list[str], hour: str = HOUR,
    state_path: str | None = None, run: int = 0, keys: list[str] | None = None,
) -> DataFrame:
    """Write all closed hours at once, read them back, and report exact verification.

    An hour that the settled tier doesn't have is written from the hot one.
    One that it has is merged with it (see `merged`), never overwritten by
    the hot rows alone: they may be no more than what came late after the
    hour had left the hot tier. Merged rows are staged, and the state names
    the folder before the hour is replaced, so a run that broke off is
    repeated from there. With a state table, hours whose hot rows are the
    verified number are left alone, and what is done is added to the table.
    Rows that change but not in number aren't noticed; upsert those.
    """
    counts = hour_counts(closed(hot, now_hour, hour), hour).withColumnRenamed("n", "hot")
    if state_path is not None:
        state = state_of(spark, state_path, hour)
        for row in state.where("step = 0 AND staged IS NOT NULL").select("staged").distinct().collect():  # a run that broke off
            write_hours(spark.read.schema(_plain(hot, hour)).parquet(row[0]), path, sort, hour)
        counts = counts.join(state.where("verified").select(hour, "hot"), [hour, "hot"], "left_anti")
    due = written(counts, "due")
    there = written(hour_counts(in_hours(_read(spark, path, hot.schema), due, hour), hour).select(hour), "there")
    fresh, again = due.join(there, hour, "left_anti"), written(due.join(there, hour, "left_semi"), "again")
    expected, staged = fresh.select(hour, "hot", F.col("hot").alias("rows"), F.lit(None).cast("string").alias("staged")), None
    if not again.isEmpty():
        staged = f"{shared_dir(spark)}/varve-merged-{uuid.uuid4().hex}"
        merged(in_hours(_read(spark, path, hot.schema), again, hour), in_hours(hot, again, hour), keys).write.parquet(staged)
        rows = hour_counts(spark.read.schema(_plain(hot, hour)).parquet(staged), hour).withColumnRenamed("n", "rows")
        expected = expected.unionByName(again.join(rows, hour).select(hour, "hot", "rows", F.lit(staged).alias("staged")))
    expected = written(expected, "expected")
    if state_path is not None:
        expected.select(F.col(hour).cast("long").alias(hour), "hot", "rows", F.lit(0).cast("long").alias("written"), F.lit(False).alias("verified"), F.lit(run).cast("long").alias("run"), F.lit(0).alias("step"), "staged").write.mode("append").parquet(state_path)
    out = in_hours(hot, fresh, hour)
    if staged is not None:
        out = out.unionByName(spark.read.schema(_plain(hot, hour)).parquet(staged))
    write_hours(out, path, sort, hour)
    there = hour_counts(in_hours(_read(spark, path, hot.schema), due, hour), hour).withColumnRenamed("n", "written")
    checked = expected.join(there, hour, "left").select(F.col(hour).cast("long").alias(hour), "hot", "rows", F.coalesce("written", F.lit(0)).alias("written"), "staged")
    report = checked.withColumn("verified", F.col("rows") == F.col("written"))
    if state_path is None:
        return report.select(hour, "rows", "written", "verified")
    report = report.withColumn("run", F.lit(run).cast("long")).withColumn("step", F.lit(1))
    report.write.mode("append").parquet(state_path)
    return spark.read.schema(_STATE.format(hour)).parquet(state_path).where((F.col("run") == run) & (F.col("step") == 1)).select(hour, "rows", "written", "verified", "run")


def _plain(hot: DataFrame, hour: str) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in hot.schema])


def backfill(spark: SparkSession, hot: DataFrame, path: str, first: int, last: int, sort: list[str], hour: str = HOUR, state_path: str | None = None, run: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Settle the hours from `first` to `last` (both included): one job, not a loop over hours."""
    return settle_hours(spark, hot.where(F.col(hour).between(first, last)), path, last + 1, sort, hour, state_path, run, keys)


def remove_days(spark: SparkSession, hot_path: str, state_path: str, stamp_path: str, at: int, hour: str = HOUR) -> DataFrame:
    """Take the droppable days of a written hot tier away, hour by hour, and stamp them.

    A day goes only if every hour it has is verified with exactly the rows it
    has now. Its hours are moved aside and counted once more there: one that
    got rows meanwhile goes back, file by file. The others are stamped, the
    state notes that the hot tier has none of their rows any more (so what
    comes later is late, whatever its number), and only then they are
    deleted. A run that broke off leaves hours aside; the next one puts back
    those without a stamp. Gives (day, hour, rows, at) of what went. Hours are
    few: their numbers go through the driver, which moves folders.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(hot_path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{hot_path.rstrip('/')}__aside"

    def put_back(number: int) -> None:
        files.mkdirs(path(f"{hot_path}/{hour}={number}"))
        for f in files.listStatus(path(f"{aside}/{hour}={number}")):
            files.rename(f.getPath(), path(f"{hot_path}/{hour}={number}/{f.getPath().getName()}"))
        files.delete(path(f"{aside}/{hour}={number}"), True)

    state = state_of(spark, state_path, hour)
    if files.exists(path(aside)):
        done = {r[0] for r in state.where("step = 2").select(hour).collect()}
        for f in files.listStatus(path(aside)):
            number = int(f.getPath().getName().rsplit("=", 1)[-1])
            if number in done:
                files.delete(f.getPath(), True)
            else:
                put_back(number)
    hot = spark.read.parquet(hot_path)
    verified = written(state.where("verified").select(hour, F.col("hot").alias("rows"), F.col("rows").alias("settled"), "run"), "verified")
    days = settle_state(hot, verified, hour).where("droppable").select("day")
    going = hour_counts(hot, hour).withColumn("day", F.expr(f"{hour} div 24")).join(days, "day", "left_semi").select(hour)
    numbers = [r[0] for r in going.collect()]
    nothing = spark.createDataFrame([], f"day long, {hour} long, rows long, at long")
    if not numbers:
        nothing.write.mode("append").parquet(stamp_path)
        return nothing
    files.mkdirs(path(aside))
    for number in numbers:
        files.rename(path(f"{hot_path}/{hour}={number}"), path(f"{aside}/{hour}={number}"))
    moved = hour_counts(spark.read.schema(hot.schema).parquet(aside), hour).select(F.col(hour).cast("long").alias(hour), "n")
    gone = written(moved.join(verified, hour).where("n = rows"), "gone")
    fine = {r[0] for r in gone.select(hour).collect()}
    for number in numbers:
        if number not in fine:
            put_back(number)
    stamps = gone.select(F.expr(f"{hour} div 24").alias("day"), hour, F.col("n").alias("rows"), F.lit(at).cast("long").alias("at"))
    stamps.write.mode("append").parquet(stamp_path)
    gone.select(hour, F.lit(0).cast("long").alias("hot"), F.col("settled").alias("rows"), F.col("settled").alias("written"), F.lit(True).alias("verified"), "run", F.lit(2).alias("step"), F.lit(None).cast("string").alias("staged")).write.mode("append").parquet(state_path)
    for number in fine:
        files.delete(path(f"{aside}/{hour}={number}"), True)
    return stamps


def apply_lifecycle(spark: SparkSession, hot_path: str, settled_path: str, state_path: str, stamp_path: str, now_hour: int, run: int, sort: list[str], hour: str = HOUR, keys: list[str] | None = None) -> DataFrame:
    """Settle what is closed, remove days that are verified, and look for leftovers.

    Gives (step, hour, rows, problem): settled and removed hours, and as
    leftover every closed hour still hot, with what keeps it there.
    """
    hot = spark.read.parquet(hot_path)
    settled = settle_hours(spark, hot, settled_path, now_hour, sort, hour, state_path, run, keys)
    removed = remove_days(spark, hot_path, state_path, stamp_path, run, hour)
    state = state_of(spark, state_path, hour).where("verified").select(hour, F.col("hot").alias("verified_rows"))
    left = hour_counts(closed(_read(spark, hot_path, hot.schema), now_hour, hour), hour).join(state, hour, "left")
    why = F.when(F.col("verified_rows").isNull(), "not verified").when(F.col("verified_rows") != F.col("n"), "rows came late").otherwise("day not over")
    nothing = F.lit(None).cast("string")
    out = settled.select(F.lit("settled").alias("step"), hour, "rows", F.when(~F.col("verified"), "not verified").alias("problem"))
    out = out.unionByName(removed.select(F.lit("removed").alias("step"), hour, "rows", nothing.alias("problem")))
    return out.unionByName(left.select(F.lit("leftover").alias("step"), F.col(hour).cast("long").alias(hour), F.col("n").alias("rows"), why.alias("problem")))


def drop_days(hot: DataFrame, verified: DataFrame, hour: str = HOUR) -> DataFrame:
    """What stays hot once every droppable day has gone."""
    gone = settle_state(hot, verified, hour).where("droppable").select(F.col("day").alias("_day"))
    return hot.join(gone, F.expr(f"{hour} div 24") == F.col("_day"), "left_anti")


def consistency(hot: DataFrame, settled: DataFrame, key: str, part: str) -> DataFrame:
    """One row: totals of both tiers, keys in both, partitions, and whether all is well."""
    shared = hot.select(key).intersect(settled.select(key)).agg(F.count("*").alias("shared"))
    twice = hot.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    totals = hot.agg(F.count("*").alias("hot_rows"), F.countDistinct(part).alias("hot_parts")).join(settled.agg(F.count("*").alias("settled_rows"), F.countDistinct(part).alias("settled_parts")))
    row = totals.join(shared).join(twice)
    errors = F.concat_ws("; ", F.when(F.col("shared") > 0, F.lit("keys in both tiers")), F.when(F.col("repeated") > 0, F.lit("repeated keys")))
    return row.select("*", errors.alias("errors"), (errors == "").alias("passed"))


def freshness(df: DataFrame, now_ns: int, by: str, ts_ns: str = "ts_ns") -> DataFrame:
    return df.groupBy(by).agg((F.lit(now_ns) - F.max(ts_ns)).alias("lag_ns"), F.count("*").alias("n"))
