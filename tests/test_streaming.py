"""Streams merge by key, in any order of batches, and lose nothing."""

import random

from pyspark.sql import functions as F

from varve.streaming import landing

SCHEMA = "k long, epoch_hour long, seq int, v int, op string"


def batches(spark, folder, parts):
    """A stream over files that come one after the other."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def made(seed):
    r = random.Random(seed)
    parts = [[(k, k % 5, r.randint(0, 50), r.randint(0, 99), r.choice(["upsert", "upsert", "delete"])) for k in r.sample(range(40), 15)] for _ in range(4)]
    newest = {}
    for row in (row for part in parts for row in part):
        if row[0] not in newest or row[2] >= newest[row[0]][2]:
            newest[row[0]] = row
    return parts, newest


def files(path):
    return sorted(str(f.relative_to(path)) for f in path.rglob("*.parquet"))


def test_replayed_batches_change_nothing_and_files_are_bounded(spark, tmp_path):
    parts, newest = made(1)
    stream = batches(spark, tmp_path, parts)
    out = tmp_path / "out"
    landing.land_hours(stream, str(out), str(tmp_path / "state"), ["k"], ["seq"])
    got = lambda: sorted((x.k, x.epoch_hour, x.seq, x.v, x.op) for x in spark.read.parquet(str(out)).collect())
    assert got() == sorted(newest.values()) and len(files(out)) <= 2 * 5
    before = len(files(out))
    landing.land_hours(stream, str(out), str(tmp_path / "again"), ["k"], ["seq"])  # all batches once more, under another checkpoint
    assert got() == sorted(newest.values()) and len(files(out)) <= before + 5


def test_projection_rewrites_touched_buckets_only(spark, tmp_path):
    parts, newest = made(2)
    stream = batches(spark, tmp_path, parts)
    out = tmp_path / "out"
    landing.project(stream, str(out), str(tmp_path / "state"), ["k"], ["seq"], buckets=8)
    live = {k: row[3] for k, row in newest.items() if row[4] != "delete"}
    assert {x.k: x.v for x in landing.projected(spark, str(out)).collect()} == live
    held = set(files(out))
    bucket = spark.createDataFrame([(7,)], "k long").select(F.pmod(F.xxhash64("k"), F.lit(8))).first()[0]
    spark.createDataFrame([(7, 0, 99, -1, "upsert")], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    landing.project(stream, str(out), str(tmp_path / "state"), ["k"], ["seq"], buckets=8)
    assert {x.k: x.v for x in landing.projected(spark, str(out)).collect()} == {**live, 7: -1}
    assert {f.split("/")[0] for f in held ^ set(files(out))} == {f"_bucket={bucket}"}


def test_rows_without_an_hour_or_before_the_bound_go_aside(spark, tmp_path):
    rows = [(1, 3, 0, 1, "upsert"), (2, 9, 0, 1, "upsert"), (3, None, 0, 1, "upsert")]
    bound = iter([5, 10])
    stream = batches(spark, tmp_path, [rows, [(4, 9, 0, 1, "upsert"), (5, 12, 0, 1, "upsert")]])
    landing.land_hours(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["k"], ["seq"], settled_before=lambda: next(bound), late_path=str(tmp_path / "late"))
    assert sorted(x.k for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 5]
    assert sorted((x.k, x._batch) for x in spark.read.parquet(str(tmp_path / "late")).collect()) == [(1, 0), (3, 0), (4, 1)]


def test_late_rows_by_the_marks_of_earlier_batches(spark, tmp_path):
    """A row is late by what came in earlier batches, in a second run too; no batch has a stateful stage."""
    import datetime

    from varve.streaming import landing

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    folder, queries = str(tmp_path), []
    for rows in ([(1, 0), (2, 600), (3, 10)], [(4, 479), (5, 480), (6, None), (7, 900)], [(8, 779), (9, 780)]):
        df = spark.createDataFrame([(i, None if m is None else at(m), 0) for i, m in rows], "event_id long, ts timestamp, epoch_hour long")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        queries.append(landing.land_with_late(stream, f"{folder}/out", f"{folder}/late", f"{folder}/state", ["event_id"], ["ts"]))
    assert [r.event_id for r in spark.read.parquet(f"{folder}/late").orderBy("event_id").collect()] == [4, 8]
    assert [r.event_id for r in spark.read.parquet(f"{folder}/out").orderBy("event_id").collect()] == [1, 2, 3, 5, 6, 7, 9]
    assert all(not p.stateOperators for q in queries for p in q.recentProgress)
