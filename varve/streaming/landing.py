"""Streams: landing by hour, incremental projections, hourly totals, timers, late rows.

Landing and projections merge each micro-batch into the hour folders or key
buckets that it touches, by key, so a replayed batch changes nothing and the
number of files follows the hours, not the batches. Results of streaming
aggregates (`land`, `landed`) have a folder for each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from varve.operators import tiers
from varve.session import ship


def land(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> StreamingQuery:
    """Write all available rows; `transform` works on each micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def landed(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, later batches after earlier ones."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return tiers.latest(rows, keys, [*order, "_batch"]).drop("_batch")


def land_hours(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], hour: str = tiers.HOUR, settled_before: Callable[[], int] | None = None, late_path: str | None = None) -> StreamingQuery:
    """Merge all available rows into the hours of a written tier.

    Each micro-batch reads and rewrites the hours it touches, once each; the
    last row of a key by `order` stays, in any order of batches. `settled_before`
    is asked at every batch, so the bound rolls forward: rows of earlier hours,
    and rows without an hour, go to `late_path`, in a folder of their batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        fine = batch
        if settled_before is not None:
            at_hand = F.coalesce(F.col(hour) >= settled_before(), F.lit(False))
            batch.where(~at_hand).write.mode("overwrite").parquet(f"{late_path}/_batch={number}")
            fine = batch.where(at_hand)
        tiers.upsert_hours(batch.sparkSession, path, fine, keys, order, hour)
        batch.unpersist()

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def project(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Merge ordered changes into a table of the newest change of each key, cut into buckets of the key.

    A micro-batch reads and rewrites only buckets that hold its keys. Deletes
    stay as rows, so an older change that comes later can't undo them.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    return land_hours(stream.withColumn("_bucket", bucket), path, checkpoint, keys, order, "_bucket")


def projected(spark: SparkSession, path: str, op: str = "op") -> DataFrame:
    """What is left of the changes: keys whose newest one isn't a delete."""
    return spark.read.parquet(path).where(F.col(op) != "delete").drop("_bucket", op)


def land_with_late(stream: DataFrame, path: str, late_path: str, checkpoint: str, keys: list[str], order: list[str], hour: str = tiers.HOUR, time: str = "ts", late_ms: int = 7_200_000) -> StreamingQuery:
    """Rows in time merge into their hours; those before the watermark of their micro-batch go to a side table instead of being dropped.

    The watermark is `late_ms` before the latest time of all earlier batches.
    Each batch leaves its own latest time in the checkpoint, which takes the
    place of a stateful stage; a replayed batch finds the same earlier ones.
    """
    marks = f"{checkpoint}/marks"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        millis = F.unix_millis(F.col(time).cast("timestamp"))
        before = tiers._read(spark, marks, "ms long, _batch int").where(F.col("_batch") < number).agg(F.max("ms")).first()[0]
        late = F.lit(False) if before is None else F.coalesce(millis < before - late_ms, F.lit(False))
        batch.agg(F.max(millis).alias("ms")).write.mode("overwrite").parquet(f"{marks}/_batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/_batch={number}")
        tiers.upsert_hours(spark, path, batch.where(~late), keys, order, hour)
        batch.unpersist()

    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def hourly(stream: DataFrame, by: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling hour; in update mode the last row of a window is its total."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), *by)
    return windows.agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), *by, "n")


def without_repeats(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def liveness(stream: DataFrame, key: str, time: str, ttl_ms: int, late: str = "2 hours") -> DataFrame:
    """(key, state, heartbeat in ms) whenever a lease changes; stream: key (long), time, released.

    A heartbeat keeps a lease alive, or releases it; a timer of event time
    makes it lapse `ttl_ms` after the last one. Of heartbeats in one
    millisecond a release counts. The state of a key is two numbers.
    """
    ship(stream.sparkSession)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            beat, released = state.get
            state.update((beat, released))
            yield pd.DataFrame({key: [keys[0]], "state": ["lapsed"], "heartbeat": [beat]})
            return
        beat, released = state.get if state.exists else (-1, False)
        for frame in frames:
            for found in zip(frame["ms"], frame["released"]):
                beat, released = max((beat, released), (int(found[0]), bool(found[1])))
        state.update((beat, released))
        now = "released" if released else "alive"
        if not released:
            if beat + ttl_ms > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(beat + ttl_ms)
            else:
                now = "lapsed"
        yield pd.DataFrame({key: [keys[0]], "state": [now], "heartbeat": [beat]})

    rows = stream.withWatermark(time, late).select(key, time, F.unix_millis(time).alias("ms"), "released")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, state string, heartbeat long", "beat long, released boolean", "update", GroupStateTimeout.EventTimeTimeout)


def pattern_sketches(stream: DataFrame, by: str, what: str, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Counts and mergeable distinct sketches by hour and pattern."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), by)
    return rows.agg(F.count("*").alias("n"), F.hll_sketch_agg(what).alias("sketch")).select(F.col("window.start").alias("hour"), by, "n", "sketch")
