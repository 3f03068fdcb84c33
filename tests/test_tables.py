"""Commits of several writers, packages, boosted trees, and rules on small inputs."""

import pytest
from pyspark.sql import functions as F

from varve import registry
from varve.functions import keys, names
from varve.operators import claims, generators, ledger, models
from varve.sources import commits, files


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """The second takes a number while the first is about to; the first takes the next one."""
    log = commits.Commits(spark, str(tmp_path / "t"))
    other, rows, plain, calls = commits.Commits(spark, str(tmp_path / "t")), spark.range(10), commits.put_if_absent, []

    def late(spark, path, text):
        calls.append(path)
        if len(calls) == 1:
            assert other.append(rows.where("id >= 5"), "b", 1)
        return plain(spark, path, text)

    monkeypatch.setattr(commits, "put_if_absent", late)
    assert log.append(rows.where("id < 5"), "a", 1)
    assert [p.rsplit("/", 1)[-1] for p in calls] == ["00000000000000000001.json", "00000000000000000001.json", "00000000000000000002.json"]
    assert sorted(r.id for r in log.read().collect()) == list(range(10))
    assert not log.append(rows, "a", 1) and not log.append(rows, "a", 0) and log.read().count() == 10


def test_compaction_covers_what_it_read(spark, tmp_path, monkeypatch):
    log, rows, plain = commits.Commits(spark, str(tmp_path / "t")), spark.range(10), commits.put_if_absent
    for k in range(3):
        log.append(rows.where(F.col("id") % 5 == k), "a", k)
    once = []

    def late(spark, path, text):
        if "compaction" in text and not once:
            once.append(1)
            commits.Commits(spark, log.path).append(rows.where("id % 5 > 2"), "b", 0)
        return plain(spark, path, text)

    monkeypatch.setattr(commits, "put_if_absent", late)
    assert log.compact(1)
    assert log.live().count() == 2 and sorted(r.id for r in log.read().collect()) == list(range(10))


def test_packages_of_two_writers(spark, tmp_path, monkeypatch):
    p, plain, once = files.Package(spark, str(tmp_path / "p")), commits.put_if_absent, []

    def late(spark, path, text):
        if not once:
            once.append(1)
            files.Package(spark, p.folder).ingest(spark.range(3), "s", "b")
        return plain(spark, path, text)

    monkeypatch.setattr(commits, "put_if_absent", late)
    p.ingest(spark.range(2), "s", "a")
    assert {(r.name, r.rows) for r in p.manifest().collect()} == {("a", 2), ("b", 3)} and p.status().first().version == 2


def test_boosted_trees_on_separable_rows(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, [float(i % 3 == k) + 0.01 * (i % 7) for k in range(3)], f"c{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "item long, x array<double>, code string").select("item", array_to_vector("x").alias("features"), "code")
    model = models.boosted(df.where("item % 4 <> 0"), members=2, rounds=2)
    found = models.boosted_probabilities(model, df.drop("code")).collect()
    assert len(found) == 120 and all(r.code == f"c{r.item % 3}" for r in found)
    assert all(sum(r.probabilities) == pytest.approx(1) and max(r.probabilities) == r.confidence and 0 <= r.variance < 0.05 for r in found)


def test_check_digits():
    """Known numbers of the two schemes."""
    from pyspark.sql import SparkSession

    one = SparkSession.active().range(1)
    row = one.select(generators.luhn_digit(F.lit("411111111111111")).alias("a"), generators.luhn_digit(F.lit("7992739871")).alias("b"), generators.iban_check("DE", F.lit("370400440532013000")).alias("c")).first()
    assert tuple(row) == ("1", "3", "89")


def test_rules_of_odd_entries(spark):
    kind = "id string, kind string, cron string, after array<string>, after_mode string, claims array<struct<leaf:string,n:long>>, enabled boolean"
    rows = [("a", "k", None, None, None, None, True), ("b", "k", "", [], "any", [("q", -1), (None, 1)], None), ("c", "k", "x", ["a"], "", [("q", 2), ("q", 2), ("z", 0)], True), (None, None, None, ["a", "gone"], None, [], False)]
    found = [tuple(r) for r in claims.entry_rules(spark.createDataFrame(rows, kind), spark.createDataFrame([("q", 3)], "leaf string, max long")).collect()]
    assert sorted(found, key=str) == sorted([
        ("a", "materialized", ""), ("b", "error", "claim q: negative; claim without a leaf; after_mode without after"),
        ("c", "error", "claim 4 on q exceeds 3; claim on unknown leaf z; both cron and after without after_mode"),
        (None, "error", "id is required; kind is required; no such predecessor gone"),
    ], key=str)


def test_capacity_gate(spark):
    leaves = spark.createDataFrame([("r.a", 2, 3), ("r.b", 4, None), ("s", None, None)], "queue string, guaranteed long, floor long")
    limits = spark.createDataFrame([("r", 6), ("r.a", 1)], "node string, max long")
    say = lambda capacity: claims.capacity_gate(leaves, limits, capacity).first().reason
    assert say(5) == "r: children guaranteed 7 > max 6; leaf guaranteed 7 > capacity 5" and say(None) == "r: children guaranteed 7 > max 6"
    assert claims.capacity_gate(leaves, limits.limit(0), 7).first().reason is None


def test_dwells_and_backlog(spark):
    rows = [(1, t, s) for t, s in enumerate(["new", "new", "placed", "new", "wait", "wait"])]
    e = spark.createDataFrame(rows, "k long, t long, state string")
    found = sorted((r.since, r.until, r.state, r.steps, r.kind, r.problem) for r in ledger.dwells(e, "k", "t", ["t"], ["wait"], ["placed"]).collect())
    assert found == [(0, 2, "new", 2, "passing", None), (2, 3, "placed", 1, "terminal", "left a terminal state"), (3, 4, "new", 1, "passing", None), (4, None, "wait", 2, "holding", "held, not done")]
    b = spark.createDataFrame([("x", 1, 1, False), ("x", 6, 2, False), ("x", 0, 3, True), ("x", 2, 4, False), ("y", 9, 1, False), ("z", 3, 1, False), ("z", 0, 2, True)], "item string, slot int, at long, ok boolean")
    assert {r.item: (r.slot, r.deepest, r.channel, r.open) for r in ledger.backlog(b).collect()} == {"x": (2, 2, "log", True), "y": (9, 9, "discussion", True), "z": (0, None, "none", False)}


def test_names_and_days(spark):
    df = spark.createDataFrame([("row_id", "int8"), ("attr_1_2", "half_float"), ("attr__1", "dictionary<utf8>"), ("data_x1", "")], "n string, t string")
    assert [tuple(r) for r in df.select(names.kind("n"), names.engine_type("t")).collect()] == [("row_id", "INT"), ("annotation", "FLOAT"), ("data", "STRING"), ("data", "STRING")]
    span = spark.sql("SELECT DATE '2024-12-30' AS a, DATE '2024-12-28' AS b")
    assert [(str(r.day), r.week) for r in keys.day_windows(span, "a", "b", backwards=True).orderBy("place").collect()] == [("2024-12-30", "2025-W01"), ("2024-12-29", "2024-W52"), ("2024-12-28", "2024-W52")]


def _with_table(sf, folder, name, rows):
    """The given tables, one of them replaced by rows of DuckDB SQL."""
    import os

    import duckdb

    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", folder / f)
    os.remove(folder / f"{name}.parquet")
    duckdb.sql(rows).write_parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["b02_uuid7_mint", "b03_uuid7_parts", "b04_uuid7_quarantine"])
def test_minutes_end_after_their_last_microsecond(spark, sf, tmp_path, name):
    from compare import assert_same

    found = _with_table(sf, tmp_path, "events", f"SELECT * REPLACE (TIMESTAMP '2024-01-01 00:00:59.999400' + INTERVAL (event_id % 5 * 200) MICROSECONDS AS ts) FROM '{sf}/events.parquet' LIMIT 10")
    assert_same(registry.queries()[name](spark, found), registry.oracles()[name], found)


def test_activations_round_doubles(spark, sf, tmp_path):
    import numpy as np
    from compare import assert_same

    x = np.arange(np.float32(0.1501), np.float32(0.3), np.float32(5e-6), dtype=np.float32)
    x = x[np.floor(x * np.float32(10_000) + np.float32(0.5)) != np.floor(x.astype(float) * 10_000 + 0.5)]
    assert len(x)
    values = ", ".join(repr(float(v)) for v in [*x, *[0.15] * 64][:64])
    found = _with_table(sf, tmp_path, "embeddings", f"SELECT vec_id, [{values}]::FLOAT[] AS embedding, label FROM '{sf}/embeddings.parquet' LIMIT 20")
    assert_same(registry.queries()["c06_activations"](spark, found), registry.oracles()["c06_activations"], found)
