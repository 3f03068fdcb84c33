"""Small exact inputs, brute force and invariants."""

import hashlib
from functools import reduce
from itertools import product

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions import keys
from varve.operators import claims, evidence, facts, graph, ledger, profile, telemetry, tiers


def test_settle_plan(spark):
    hot = spark.createDataFrame([(100,)] * 10 + [(101,)] * 3, "epoch_hour long")
    settled = spark.createDataFrame([(100,)] * 10, "epoch_hour long")
    found = {r.epoch_hour: r.verdict for r in tiers.reconcile(hot, settled, 101).collect()}
    assert found == {100: "drop", 101: "live"}
    short = {r.epoch_hour: r.verdict for r in tiers.reconcile(hot, settled.limit(2), 101).collect()}
    assert short[100] == "refuse"
    none = {r.epoch_hour: r.verdict for r in tiers.reconcile(hot, settled.limit(0), 101).collect()}
    assert none[100] == "analog"


def test_late_rows_reopen_a_day(spark):
    hot = spark.createDataFrame([(100,)] * 11, "epoch_hour long")
    verified = spark.createDataFrame([(100, 10)], "epoch_hour long, rows long")
    assert tiers.drop_days(hot, verified).count() == 11


def test_settle_twice_is_the_same(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 5).alias("epoch_hour"), F.col("id").alias("ts_ns"), F.lit(1).alias("series_id"))
    path = str(tmp_path / "tier")
    for _ in range(2):
        report = tiers.settle_hours(spark, rows, path, 4, ["series_id", "ts_ns"]).collect()
        assert all(r.verified for r in report) and len(report) == 4
    assert spark.read.parquet(path).count() == 400


def test_union_view_with_new_column_and_without_settled(spark):
    hot = spark.createDataFrame([(5, 1)], "epoch_hour long, x long")
    old = spark.createDataFrame([(4,), (5,)], "epoch_hour long")
    assert sorted(map(tuple, tiers.union_view(hot, old).collect()), key=str) == [(4, None), (5, 1)]
    assert tiers.union_view(hot).count() == 1


def test_uuid7(spark):
    df = spark.createDataFrame([("017f22e2-79b0-7cc3-98c4-dc0c0c07398f",), ("d9428888-122b-41e1-b85c-61aab2a0fd52",), (None,), ("x",)], "tx string")
    got = [tuple(r) for r in df.select(keys.is_uuid7("tx"), keys.uuid7_millis("tx")).collect()]
    assert got == [(True, 0x017F22E279B0), (False, None), (False, None), (False, None)]
    fine, bad = keys.quarantine(df, "tx", "test")
    assert fine.count() == 1 and {r.issue.kind for r in bad.collect()} == {"missing", "malformed", "wrong-version"}


def test_uuid7_overflow_and_order(spark):
    df = spark.range(5000).select(F.lit(1_700_000_000_000).alias("ms"), F.col("id").alias("k"))
    made = [r.uuid for r in keys.mint_uuid7(df, "ms", "k").orderBy("k").collect()]
    assert made == sorted(made) and len(set(made)) == 5000


def test_retracted_fact_is_gone(spark):
    log = spark.createDataFrame([("p", "a", "1", "t1", True, 1), ("p", "a", "1", "t2", False, 2), ("p", "b", "2", "t1", True, 1), ("q", "a", "9", "t1", False, 1)], "e string, a string, v string, t string, op boolean, ts_ns long")
    assert [tuple(r) for r in facts.project(log, ["a", "b"]).collect()] == [("p", None, "2", "t1")]


def test_correction_before_its_observation_is_ignored(spark):
    log = spark.createDataFrame([(1, 5, None, False), (1, 2, True, True), (2, 1, None, False), (2, 3, True, True), (2, 4, False, True)], "id long, seq long, outcome boolean, is_correction boolean")
    assert {r.id: r.outcome for r in ledger.folded(log).collect()} == {1: None, 2: False}


def test_uncalibrated_trust(spark):
    obs = spark.createDataFrame([("o", 0.7, None)], "observer string, p double, outcome boolean")
    row = ledger.trust(ledger.brier(obs, ["observer"])).first()
    assert (row.alpha, row.risk, row.brier) == (0.5, 0.5, None)


def test_fleet_reduction(spark):
    rows = [("a", s) for s in ("completing", "running", "completed")] + [("b", s) for s in ("completed", "missing")] + [("c", "odd")]
    found = ledger.worst_state(spark.createDataFrame(rows, "fleet string, state string"), "fleet", list(ledger.SEVERITY))
    assert {r.fleet: r.state for r in found.collect()} == {"a": "running", "b": "completed", "c": "unknown"}


def test_frontier_of_the_fixed_graph(spark):
    n = 100
    edges = {(i, i + 1) for i in range(n - 1)} | {(i, (i + 1 + 7) % n) for i in range(n)}
    df = spark.createDataFrame([(a, b) for a, b in edges if a != b], "src long, dst long")
    found = {r.node: r.hop for r in graph.frontier(df, spark.createDataFrame([(0,)], "node long"), 4).collect()}
    seen, last = {0: 0}, {0}
    for hop in range(1, 5):
        last = {b for a, b in edges if a in last} - seen.keys()
        seen |= dict.fromkeys(last, hop)
    assert found == seen


def brute_force(sources, leaves):
    """Dempster's rule over explicit subsets; (masses, conflict)."""
    everything = frozenset(leaves)
    as_set = lambda f: everything if f == evidence.THETA else frozenset(f.split("|"))
    total = {everything: 1.0}
    for masses in sources:
        out = {}
        for (a, x), (f, y) in product(total.items(), masses.items()):
            out[a & as_set(f)] = out.get(a & as_set(f), 0.0) + x * y
        total = out
    conflict = total.pop(frozenset(), 0.0)
    good = 1 - conflict
    return ({everything: 1.0}, 1.0) if good < 1e-14 else ({s: m / good for s, m in total.items() if m > 1e-15}, conflict)


@pytest.mark.parametrize(
    "sources",
    [
        [{"a": 0.5, "b": 0.2, "*": 0.3}, {"a": 0.1, "c": 0.6, "*": 0.3}],
        [{"a": 1.0, "*": 0.0}, {"b": 1.0, "*": 0.0}],
        [{"a|b": 0.4, "a": 0.3, "*": 0.3}, {"b|c": 0.5, "d": 0.1, "*": 0.4}, {"*": 1.0}],
        [{"a": 0.6, "b": 0.4, "*": 0.0}, {"a": 0.2, "a|b": 0.3, "*": 0.5}, {"b": 0.9, "*": 0.1}],
        [{"*": 1.0}],
    ],
)
def test_fusion_equals_brute_force(spark, sources):
    rows = [("i", f"s{n}", f, float(m)) for n, masses in enumerate(sources) for f, m in masses.items()]
    got = evidence.fuse(spark.createDataFrame(rows, "item string, source string, focal string, mass double")).collect()
    expected, conflict = brute_force(sources, "abcd")
    everything = frozenset("abcd")
    found = {everything if r.focal == "*" else frozenset(r.focal.split("|")): r.mass for r in got}
    assert found == pytest.approx(expected, abs=1e-12)
    assert got[0].conflict == pytest.approx(conflict, abs=1e-12)
    assert sum(found.values()) == pytest.approx(1)


def test_many_sources_are_no_total_conflict(spark):
    sources = [{"a": 0.95, "*": 0.05} if n % 2 else {"b": 0.95, "*": 0.05} for n in range(24)] + [{"a|c": 0.4, "*": 0.6}]
    rows = [("i", f"s{n}", f, float(m)) for n, masses in enumerate(sources) for f, m in masses.items()]
    got = evidence.fuse(spark.createDataFrame(rows, "item string, source string, focal string, mass double")).collect()
    # brute force with every step made relative to what is left
    everything, total, left = frozenset("abcd"), {frozenset("abcd"): 1.0}, 1.0
    for masses in sources:
        out = {}
        for (a, x), (f, y) in product(total.items(), masses.items()):
            both = a & (everything if f == evidence.THETA else frozenset(f.split("|")))
            out[both] = out.get(both, 0.0) + x * y
        out.pop(frozenset(), None)
        good = sum(out.values())
        left, total = left * good, {s: m / good for s, m in out.items()}
    found = {everything if r.focal == "*" else frozenset(r.focal.split("|")): r.mass for r in got}
    assert {s: m for s, m in found.items() if m > 1e-9} == pytest.approx({s: m for s, m in total.items() if m > 1e-9}, rel=1e-6)
    assert got[0].conflict == pytest.approx(1 - left, abs=1e-9) and got[0].conflict < 1


def test_fusion_with_inner_nodes_equals_brute_force(spark):
    tree = [("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("f", "z"), ("x", "w"), ("y", "w"), ("z", "r"), ("w", "r"), ("r", None)]
    frame = evidence.Frame.of(spark.createDataFrame(tree, "code string, parent string"), [("a", "b"), ("c", "d")])
    sets = {"x": "abc", "d|e": "de", "w": "abcde", "*": "abcdef", "f": "f"}
    as_set = lambda f: frozenset(sets.get(f, f.replace("|", "")))
    assert (frame.named["y"], frame.named["z"], frame.named["r"], frame.nodes["w"]) == ("d|e", "f", "*", frozenset("abcde"))
    sources = [{"x": 0.5, "a": 0.2, "*": 0.3}, {"w": 0.4, "a|b": 0.3, "f": 0.1, "*": 0.2}, {"d|e": 0.2, "c|d": 0.2, "b": 0.2, "*": 0.4}, {"w": 0.9, "*": 0.1}]
    rows = [("i", f"s{n}", f, float(m)) for n, masses in enumerate(sources) for f, m in masses.items()]
    fused = evidence.fuse(spark.createDataFrame(rows, "item string, source string, focal string, mass double"), frame)
    total = {frozenset("abcdef"): 1.0}
    for masses in sources:
        out = {}
        for (a, x), (f, y) in product(total.items(), masses.items()):
            out[a & as_set(f)] = out.get(a & as_set(f), 0.0) + x * y
        total = out
    conflict = total.pop(frozenset(), 0.0)
    expected = {s: m / (1 - conflict) for s, m in total.items()}
    assert {as_set(r.focal): r.mass for r in fused.collect()} == pytest.approx(expected, abs=1e-12)
    found = {r.code: (r.bel, r.pl, r.betp) for r in evidence.intervals(fused, frame).collect()}
    assert found.keys() == set("abcdef") | set("xyzwr")
    for code, (bel, pl, betp) in found.items():
        of = frozenset({"x": "abc", "y": "de", "z": "f", "w": "abcde", "r": "abcdef"}.get(code, code))
        assert bel == pytest.approx(sum(m for s, m in expected.items() if s <= of))
        assert pl == pytest.approx(sum(m for s, m in expected.items() if s & of))
        assert betp == pytest.approx(sum(m / len(s) for s, m in expected.items() if code in s) if code in "abcdef" else 0)
    assert evidence.decide(evidence.intervals(fused, frame)).first().code in "abcdef"


def test_intervals_hold_every_leaf(spark):
    rows = [("i", "a", 1.0, 0.0), ("j", "*", 1.0, 0.0)]
    frame = spark.createDataFrame([(c,) for c in "abcd"], "code string")
    found = {(r.item, r.code): (r.bel, r.pl, r.betp) for r in evidence.intervals(spark.createDataFrame(rows, "item string, focal string, mass double, conflict double"), frame).collect()}
    assert len(found) == 8 and found["i", "b"] == (0, 0, 0) and found["j", "b"] == (0, 1, 0.25) and found["i", "a"] == (1, 1, 1)


def test_closure_of_a_deep_tree_and_a_cycle(spark):
    tree = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(40)] + [("p", "q"), ("q", "p")], "code string, parent string")
    found = {tuple(r) for r in evidence.closure(tree).collect()}
    assert found == {(f"n{a}", f"n{b}") for a in range(40) for b in range(a + 1)} | {("p", "q"), ("q", "p"), ("p", "p"), ("q", "q")}


def test_open_windows_and_repeated_ids(spark):
    rows = [("a", 0, 0, "accepted"), ("b", None, None, "accepted"), ("c", 5, 0, "accepted"), ("d", 11, 0, "accepted"), ("e", 0, 10, "accepted"), ("f", 0, 11, "accepted"), ("g", 0, 0, "new")]
    live = claims.live(spark.createDataFrame(rows, "queue string, valid_from long, valid_until long, state string"), 10)
    assert {r.queue for r in live.collect()} == {"a", "b", "c", "f"}
    log = [(1, 1, "x", None, False), (1, 3, "y", None, False), (1, 2, None, True, True), (2, 1, "z", None, False)]
    found = {r.id: (r.what, r.outcome) for r in ledger.folded(spark.createDataFrame(log, "id long, seq long, what string, outcome boolean, is_correction boolean")).collect()}
    assert found == {1: ("y", None), 2: ("z", None)}
    requests = [("p", 1, 1, ["k"], None), ("p", 1, 5, ["m"], None), ("p", 2, 2, ["k"], None)]
    found = {r.id: (r.at, r.retired) for r in claims.superseded(spark.createDataFrame(requests, "peer string, id long, at long, keys array<string>, supersedes long")).collect()}
    assert found == {1: (5, False), 2: (2, False)}


def test_intervals_are_ordered(spark):
    rows = [("i", "s", "a|b", 0.4), ("i", "s", "a", 0.3), ("i", "s", "*", 0.3), ("i", "t", "c", 0.5), ("i", "t", "*", 0.5)]
    frame = spark.createDataFrame([(c,) for c in "abcd"], "code string")
    found = evidence.intervals(evidence.fuse(spark.createDataFrame(rows, "item string, source string, focal string, mass double")), frame).collect()
    assert found and all(r.bel <= r.betp + 1e-12 and r.betp <= r.pl + 1e-12 for r in found)


def test_over_commit_and_budget(spark):
    leaves = spark.createDataFrame([("root.a.x", 4, None), ("root.a.y", 1, None), ("root.a.z", 1, 2)], "queue string, guaranteed int, floor int")
    b = claims.budgets(leaves)
    assert {r.node: r.guaranteed for r in b.collect()}["root.a"] == 7
    assert claims.over_budget(b, spark.createDataFrame([("root.a", 6)], "node string, max int")).count() == 1


def test_exposition(spark):
    lines = spark.createDataFrame([('# HELP x', ), ('up{a="1",b="x y"} 2.5',), ("plain 7",), ("bad{",), ("nan_value oops",)], "value string")
    assert sorted((r.name, dict(r.labels), r.value) for r in telemetry.exposition(lines).collect()) == [("plain", {}, 7.0), ("up", {"a": "1", "b": "x y"}, 2.5)]


def test_exposition_with_repeated_and_escaped_labels(spark):
    lines = spark.createDataFrame([('up{a="1",a="2",b="say \\"x\\", y"} 1',)], "value string")
    assert [dict(r.labels) for r in telemetry.exposition(lines).collect()] == [{"a": "2", "b": 'say "x", y'}]


def test_as_of_tie_takes_the_label(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 10, "new"), (1, 6, "old")], "k long, u long, label string")
    found = {(r.k, r.t): r.label for r in telemetry.as_of(left, right, ["k"], "t", "u", "label").collect()}
    assert found == {(1, 10): "new", (1, 5): None, (2, 9): None}


def test_lifecycle(spark):
    rows = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("part"), F.lit(0).alias("seq"), F.lit("old").alias("v"))
    hot = tiers.upsert(rows, rows.where("part < 4 AND event_id div 10 % 5 = 0").withColumn("v", F.lit("new")).withColumn("seq", F.lit(1)), ["event_id"], ["seq"])
    cold, left = hot.where("part >= 8"), hot.where("part < 8")
    row = tiers.consistency(left, cold, "event_id", "part").first()
    assert (row.hot_rows, row.settled_rows, row.shared, row.repeated, row.passed) == (800, 200, 0, 0, True)
    assert reduce(lambda n, r: n + (r.v == "new"), hot.collect(), 0) == 80


def test_propagation_in_blocks_uses_every_source(spark, monkeypatch):
    from varve.operators import labels

    places = [-70, 0, 10, 900, 901, 50_000, None]
    unit = [[float(i == k) for i in range(len(places))] for k in range(len(places))]
    sources = spark.createDataFrame([(p, v, f"c{k}", 1.0) for k, (p, v) in enumerate(zip(places, unit))], "place long, vector array<double>, code string, confidence double")
    targets = spark.createDataFrame([(k, v, None, None) for k, v in enumerate(unit)], "item long, vector array<double>, guess string, guess_confidence double")
    monkeypatch.setattr(labels, "CELL_ROWS", 2)
    for pivots in (1, 3, 64):
        assert {r.item: r.code for r in labels.propagate(targets, sources, pivots=pivots).collect()} == {k: f"c{k}" for k in range(len(places))}


def test_pivots_rule_pairs_out_and_miss_none(spark):
    """Clustered vectors: as many similar pairs as among all, from a small part of them."""
    import numpy as np

    from varve.operators import labels

    r = np.random.default_rng(2)
    v = r.normal(size=(20, 16))[r.integers(0, 20, 400)] + 0.05 * r.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    targets = spark.createDataFrame([(i, v[i].tolist(), None, None) for i in range(300)], "item long, vector array<double>, guess string, guess_confidence double")
    sources = spark.createDataFrame([(i, v[i].tolist(), f"c{i}", 1.0) for i in range(300, 400)], "place long, vector array<double>, code string, confidence double")
    found = labels.candidates(targets, sources).collect()
    assert {(x.item, x.place) for x in found if x.sim >= 0.85} == {(i, j) for i in range(300) for j in range(300, 400) if v[i] @ v[j] >= 0.85}
    assert len(found) == len({(x.item, x.place) for x in found}) < 0.5 * 300 * 100


def test_propagation_pairs_only_targets_that_the_first_sources_leave(spark, monkeypatch):
    """Targets that fit one of the first sources meet no others; the rest finds later ones; refusals hold in both."""
    import numpy as np

    r = np.random.default_rng(5)
    v = r.normal(size=(260, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    guesses = ["c1", None, "c0"]
    targets = spark.createDataFrame([(i, v[i].tolist() if i else None, guesses[i % 3], [0.9, 0.4][i % 2]) for i in range(160)], "item long, vector array<double>, guess string, guess_confidence double")
    sources = spark.createDataFrame([(i, v[i].tolist(), f"c{i % 2}", 0.5) for i in range(160, 260)], "place long, vector array<double>, code string, confidence double")
    expected = {}
    for i in range(1, 160):
        fit = [j for j in range(160, 260) if v[i] @ v[j] >= 0.5 and not (guesses[i % 3] not in (None, f"c{j % 2}") and i % 2 == 0)]
        if fit:
            expected[i] = (f"c{fit[0] % 2}", v[i] @ v[fit[0]] * 0.5)
    from varve.operators import labels

    plain, asked = labels.candidates, []
    monkeypatch.setattr(labels, "candidates", lambda rest, *a: asked.append(rest.count()) or plain(rest, *a))
    for first in (20, 1_000):
        monkeypatch.setattr(labels, "FIRST", first)
        found = {x.item: (x.code, x.confidence) for x in labels.propagate(targets, sources, similarity=0.5).collect()}
        assert {k: c for k, (c, _) in found.items()} == {k: c for k, (c, _) in expected.items()}
        assert all(found[k][1] == pytest.approx(expected[k][1]) for k in expected)
    assert len(asked) == 1 and 0 < asked[0] < 150


def test_blocks_of_targets_and_sources_give_the_first_pairs_only(spark, monkeypatch):
    """No row for each pair: of a block of sources a target gets the first one it doesn't refuse; odd vectors meet none."""
    import numpy as np

    from varve.operators import labels

    r = np.random.default_rng(8)
    v = r.normal(size=(700, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    guess = lambda i: [None, "c1", "c2"][i % 3]
    targets = [(f"t{i}", v[i].tolist(), guess(i), 0.9) for i in range(400)] + [("null", None, None, 0.9), ("hole", [None, *v[1, 1:].tolist()], None, 0.9), ("short", v[2, :5].tolist(), None, 0.9)]
    sources = [(i, v[i].tolist(), f"c{i % 3}", 0.5) for i in range(400, 700)] + [(1, None, "c0", 0.5), (2, [None, *v[1, 1:].tolist()], "c0", 0.5)]
    targets = spark.createDataFrame(targets, "item string, vector array<double>, guess string, guess_confidence double")
    sources = spark.createDataFrame(sources, "place long, vector array<double>, code string, confidence double")
    monkeypatch.setattr(labels, "CELL_ROWS", 30)
    monkeypatch.setattr(labels, "SIDE", 25)
    similar = {(f"t{i}", j) for i in range(400) for j in range(400, 700) if v[i] @ v[j] >= 0.5}
    assert {(x.item, x.place) for x in labels.candidates(targets, sources, 0.5, 4).collect()} == similar
    taken = {(t, j) for t, j in similar if guess(int(t[1:])) in (None, f"c{j % 3}")}
    found = labels.candidates(targets, sources, 0.5, 4, 0.5).collect()
    assert {x.item: min(y.place for y in found if y.item == x.item) for x in found} == {t: min(j for u, j in taken if u == t) for t, _ in taken}
    assert {(x.item, x.place) for x in found} <= taken and len(found) == len({(x.item, x.place) for x in found}) < 0.6 * len(taken)
    assert all(x.sim == pytest.approx(v[int(x.item[1:])] @ v[x.place]) for x in found)


@pytest.mark.parametrize(("name", "source", "key", "folds"), [("m1_lexical", "documents", "doc_id", 10), ("m2_forest", "embeddings", "vec_id", 5)])
def test_models_return_a_row_for_every_item(spark, sf, name, source, key, folds):
    from varve import registry

    found = sorted((r[0], r.held_out) for r in registry.queries()[name](spark, sf).collect())
    assert found == sorted((r[0], r[0] % folds == 0) for r in spark.read.parquet(f"{sf}/{source}.parquet").select(key).collect())


def _embeddings(spark, sf):
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])


def test_importance_against_numpy(spark, sf):
    import numpy as np

    from varve import registry

    _, v, _ = _embeddings(spark, sf)
    a, b, n = v[:, 0], v[:, 1], len(v)
    truth = (a > 0).astype(int)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(3 * a - 0.01 * b)))
        return -np.log(np.where(truth == 1, p, 1 - p) + 1e-12)

    other = [(np.arange(n) + k * 7919) % n for k in range(1, 9)]
    gains = {"a": [np.mean(loss(a[o], b) - loss(a, b)) for o in other], "b": [np.mean(loss(a, b[o]) - loss(a, b)) for o in other]}
    found = {r.feature: (r.mean, r.std) for r in registry.queries()["d22_importance"](spark, sf).collect()}
    assert found == {f: pytest.approx((np.mean(g), np.std(g)), abs=1e-9) for f, g in gains.items()}


def test_vectors_have_unit_length_and_tell_texts_apart(spark):
    from pyspark.ml.functions import vector_to_array

    from varve.operators import models

    df = spark.createDataFrame([(0, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "alpha beta delta"), (3, "uno dos tres")], "id long, text string")
    v = {r.id: r.v for r in models.vectors(df).select("id", vector_to_array("vector").alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(v[0], v[0]) == pytest.approx(1) and v[0] == v[1] and dot(v[0], v[2]) > dot(v[0], v[3])


def test_out_of_fold_and_self_training(spark):
    from pyspark.ml.functions import array_to_vector

    from varve.operators import models

    rows = [(i, [float(i % 3 == k) + 0.01 * (i % 7) for k in range(3)], f"c{i % 3}") for i in range(240)]
    df = spark.createDataFrame(rows, "item long, x array<double>, code string").select("item", array_to_vector("x").alias("features"), "code")
    found = models.out_of_fold(df.where("item % 20 <> 0"), df.where("item % 20 = 0"), 3).collect()
    assert sorted(r.item for r in found) == [i for i in range(240) if i % 20] and all(r.code == r.truth for r in found)
    assert {r.fold for r in found} == {0, 1, 2}
    some = df.withColumn("code", F.when(F.col("item") % 2 == 0, F.col("code")))
    full = models.full_fit(some.where("item % 20 <> 0"), some.where("item % 20 = 0"), 2).collect()
    assert {r.item: r.code for r in full} == {i: f"c{i % 3}" for i in range(240) if i % 20} and all((r.fold is None) == (r.item % 2 == 1) == (r.truth is None) for r in full)
    sure = models.self_train(df.where("item % 4 = 0"), df.where("item % 4 <> 0").drop("code")).collect()
    assert {r.item: r.code for r in sure} == {i: f"c{i % 3}" for i in range(240) if i % 4}


def test_calibrated_probabilities_after_reading_the_model_back(spark):
    from varve.operators import models

    rows = [(i, " ".join(["der die das und", "the and of to", "le la les et"][i % 3].split()[k % 4] for k in range(i % 5 + 3)), ["de", "en", "fr"][i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = models.saved(models.calibrated(models.lexical(df.where("doc_id % 5 > 1"), "lang"), df.where("doc_id % 5 = 1")), spark)
    found = models.probabilities(model, df).collect()
    assert len(found) == 90 and all(sum(r.probabilities) == pytest.approx(1, abs=1e-3) and len(r.probabilities) == 3 for r in found)
    assert sum(r.code == r.lang for r in found) > 85


def test_as_of_across_buckets(spark):
    import random

    r = random.Random(3)
    left = [(i, r.randint(0, 2), r.randint(0, 300)) for i in range(300)]
    right = [(r.randint(0, 2), t, f"v{t}" if r.random() > 0.2 else None) for t in r.sample(range(300), 60)]
    a = spark.createDataFrame(left, "i long, k long, t long")
    b = spark.createDataFrame(right, "k long, u long, label string")
    expected = {i: max(((u, v) for key, u, v in right if key == k and u <= t and v), default=(0, None))[1] for i, k, t in left}
    for width in (1, 7, 50, 1 << 30):
        assert {x.i: x.label for x in telemetry.as_of(a, b, ["k"], "t", "u", "label", width).collect()} == expected


def test_lifecycle_on_written_tiers(spark, tmp_path):
    rows = spark.range(2400).select((F.col("id") % 60).alias("epoch_hour"), F.col("id").alias("ts_ns"), F.lit(1).alias("series_id"))
    hot, settled, state, stamps = (str(tmp_path / x) for x in ("hot", "settled", "state", "stamps"))
    tiers.write_hours(rows, hot, ["ts_ns"])
    report = tiers.apply_lifecycle(spark, hot, settled, state, stamps, 50, 1, ["ts_ns"]).collect()
    steps = {}
    for r in report:
        steps.setdefault((r.step, r.problem), set()).add(r.epoch_hour)
    assert steps == {("settled", None): set(range(50)), ("removed", None): set(range(48)), ("leftover", "day not over"): {48, 49}}
    assert {r[0] for r in spark.read.parquet(hot).select("epoch_hour").distinct().collect()} == set(range(48, 60))
    # a late row opens its hour again, others are left alone
    late = spark.createDataFrame([(49, 9999, 1)], "epoch_hour long, ts_ns long, series_id int")
    second = tiers.settle_hours(spark, spark.read.parquet(hot).unionByName(late), settled, 50, ["ts_ns"], state_path=state, run=2).collect()
    assert [(r.epoch_hour, r.rows, r.verified) for r in second] == [(49, 41, True)]
    assert tiers.state_of(spark, state).where("run = 1").count() == 49 and spark.read.parquet(settled).count() == 2001


def _tier(spark, hours=60, each=40):
    return spark.range(hours * each).select((F.col("id") % hours).alias("epoch_hour"), F.col("id").alias("ts_ns"), F.lit(1).alias("series_id"))


def _late(spark, rows):
    return spark.createDataFrame(rows, "epoch_hour long, ts_ns long, series_id int")


def _counts(spark, path):
    return {r[0]: r[1] for r in spark.read.parquet(path).groupBy("epoch_hour").count().collect()}


@pytest.mark.parametrize("keys", [["ts_ns"], None])
@pytest.mark.parametrize("late", [1, 40])
def test_late_rows_after_removal_are_merged(spark, tmp_path, keys, late):
    """The settled hour keeps its rows, even if as many come late as were removed."""
    hot, settled, state, stamps = (str(tmp_path / x) for x in ("hot", "settled", "state", "stamps"))
    tiers.write_hours(_tier(spark), hot, ["ts_ns"])
    apply = lambda run: tiers.apply_lifecycle(spark, hot, settled, state, stamps, 50, run, ["ts_ns"], keys=keys).collect()
    apply(1)
    assert 5 not in _counts(spark, hot) and _counts(spark, settled)[5] == 40
    extra = [(5, 10_000 + k, 1) for k in range(late)]
    tiers.write_hours(_late(spark, extra), hot, ["ts_ns"])
    steps = [(r.step, r.epoch_hour, r.rows, r.problem) for r in apply(2) if r.step != "leftover"]
    assert steps == [("settled", 5, 40 + late, None), ("removed", 5, late, None)]
    assert _counts(spark, settled) == {h: 40 + late * (h == 5) for h in range(50)} and 5 not in _counts(spark, hot)
    assert [r for r in apply(3) if r.step != "leftover"] == []
    tiers.write_hours(_late(spark, extra), hot, ["ts_ns"])  # the same again: nothing new, nothing lost
    apply(4)
    assert _counts(spark, settled)[5] == 40 + late and spark.read.parquet(stamps).where("epoch_hour = 5").count() == 3


def test_settling_without_a_state_table_keeps_settled_rows(spark, tmp_path):
    path = str(tmp_path / "settled")
    tiers.settle_hours(spark, _tier(spark, 4), path, 4, ["ts_ns"])
    tiers.settle_hours(spark, _late(spark, [(2, 999, 1), (2, 999, 1)]), path, 4, ["ts_ns"])
    assert _counts(spark, path) == {0: 40, 1: 40, 2: 42, 3: 40}


def test_a_settle_run_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    hot, settled, state, stamps = (str(tmp_path / x) for x in ("hot", "settled", "state", "stamps"))
    tiers.write_hours(_tier(spark), hot, ["ts_ns"])
    tiers.apply_lifecycle(spark, hot, settled, state, stamps, 50, 1, ["ts_ns"])
    late = _late(spark, [(5, 10_000, 1)])
    whole = tiers.write_hours

    def broken(df, path, *rest):
        spark._jvm.org.apache.commons.io.FileUtils.deleteDirectory(spark._jvm.java.io.File(f"{path}/epoch_hour=5"))
        raise RuntimeError("lost")

    monkeypatch.setattr(tiers, "write_hours", broken)
    with pytest.raises(RuntimeError, match="lost"):
        tiers.settle_hours(spark, late, settled, 50, ["ts_ns"], state_path=state, run=2)
    monkeypatch.setattr(tiers, "write_hours", whole)
    assert 5 not in _counts(spark, settled)
    tiers.settle_hours(spark, late, settled, 50, ["ts_ns"], state_path=state, run=3)
    assert _counts(spark, settled) == {h: 40 + (h == 5) for h in range(50)}


def test_rows_that_land_while_a_day_is_removed_stay(spark, tmp_path, monkeypatch):
    """An hour that gets a file between the count and the move goes back."""
    hot, settled, state, stamps = (str(tmp_path / x) for x in ("hot", "settled", "state", "stamps"))
    tiers.write_hours(_tier(spark, 48), hot, ["ts_ns"])
    tiers.settle_hours(spark, spark.read.parquet(hot), settled, 48, ["ts_ns"], state_path=state, run=1)
    plain = tiers.settle_state

    def landing(df, verified, hour):
        found = tiers.written(plain(df, verified, hour), "early")
        _late(spark, [(7, 77_777, 1)]).write.mode("append").partitionBy("epoch_hour").parquet(hot)
        return found

    monkeypatch.setattr(tiers, "settle_state", landing)
    gone = {r.epoch_hour for r in tiers.remove_days(spark, hot, state, stamps, 9).collect()}
    assert gone == set(range(48)) - {7} and _counts(spark, hot) == {7: 41}


def test_only_touched_hours_are_read(spark, tmp_path):
    path = str(tmp_path / "tier")
    tiers.write_hours(_tier(spark), path, ["ts_ns"])
    found = tiers.in_hours(spark.read.parquet(path), _late(spark, [(5, 1, 1), (7, 1, 1)]))
    assert "PartitionFilters: [epoch_hour" in found._jdf.queryExecution().toString()
    assert {int(r[0].split("epoch_hour=")[1].split("/")[0]) for r in found.select(F.input_file_name()).distinct().collect()} == {5, 7}
    before = {f: (tmp_path / "tier" / f"epoch_hour={f}").stat().st_mtime_ns for f in range(60)}
    tiers.upsert_hours(spark, path, _late(spark, [(5, 5, 2), (5, 4444, 2)]), ["ts_ns"], ["ts_ns"])
    after = {f: (tmp_path / "tier" / f"epoch_hour={f}").stat().st_mtime_ns for f in range(60)}
    assert {f for f in before if before[f] != after[f]} == {5} and _counts(spark, path)[5] == 41


def test_keys_that_move_have_one_row(spark, tmp_path):
    import random

    from varve.operators.keyed import KeyedTier

    r, schema = random.Random(4), "k long, epoch_hour long, seq int, v int"
    tier = KeyedTier(spark, str(tmp_path / "keyed"), ["k"], ["seq"], spark.createDataFrame([], schema).schema, buckets=4)
    expected = {}
    for run in range(1, 4):
        rows = [(r.randint(0, 60), r.randint(0, 9), r.randint(run - 1, run + 1), r.randint(0, 999)) for _ in range(50)] + [(None, run, run, run)]
        newest = {}
        for k, h, s, v in rows:
            newest[k] = max(newest.get(k, (s, h, v)), (s, h, v))
        changes = spark.createDataFrame([(k, h, s, v) for k, (s, h, v) in newest.items()], schema)
        for k, (s, h, v) in newest.items():
            if k not in expected or s >= expected[k][0]:
                expected[k] = (s, h, v)
        for _ in range(2):  # the same run again changes nothing
            tier.land(changes, run)
        got = lambda: {x.k: (x.seq, x.epoch_hour, x.v) for x in tier.rows().collect()}
        assert tier.rows().count() == len(expected) and got() == expected
        if run == 2:
            tier.compact()
            assert got() == expected and tier.stored() == len(expected) and tier.deletes().count() == 0


def test_lexical_rounds_in_one_session(spark):
    """Fit and apply again and again: plans stay short, and each gives the same."""
    from varve.operators import models

    rows = [(i, [None, "the and of to", "der die das und"][(i % 3 > 0) * (1 + i % 2)], ["en", "de"][i % 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = set()
    for _ in range(6):
        scored = models.applied(models.lexical(df.where("text IS NOT NULL"), "lang"), df)
        assert len(scored._jdf.queryExecution().executedPlan().toString()) < 20_000
        found.add(tuple(sorted((r.doc_id, r.prediction) for r in scored.collect())))
    assert len(found) == 1 and len(next(iter(found))) == 24


def test_lexical_blocks_are_bounded_and_plans_hold_no_model(spark, monkeypatch):
    """No row, batch or plan holds more than a block of terms, and scoring has no JVM function with the weights in it."""
    import numpy as np

    from varve.operators import models

    monkeypatch.setattr(models, "BLOCK", 500)
    rows = [(i, " ".join(f"w{i * 31 % 97 + k}" for k in range(40)), ["en", "de", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    found = models.blocks(df, ["de", "en"], "lang", "text").collect()
    sizes = [np.frombuffer(r.sizes, np.int32) for r in found]
    assert sum(len(s) for s in sizes) == 40 and all(s[:-1].sum() < 500 for s in sizes)
    scored = models.applied(models.lexical(df, "lang"), df)
    assert "UDF(" not in scored._jdf.queryExecution().executedPlan().toString().replace("margins(", "") and scored.count() == 60


def test_lexical_blocks_take_two_bytes_a_term_and_lose_none(spark):
    """Wide gaps, counts beyond a byte and empty texts come back as they were; steps read no more than that."""
    import random
    from collections import Counter

    from varve.operators import models

    r = random.Random(4)
    texts = ["", "a", "a" * 3000, "x y " * 700, "é\u0085ß İ 😀", *(" ".join(f"w{r.randint(0, 900)}" for _ in range(r.choice((1, 300)))) for _ in range(40))]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(2)
    stored = models.blocks(df, ["en"], "lang", "text")
    found = [(tuple(codes[counts > 0]), tuple(counts[counts > 0])) for _, some in models._opened(stored.toArrow().to_batches()) for codes, counts in some]
    terms = [tuple(map(tuple, models._codes(t))) for t in texts]
    assert Counter(found) == Counter(terms)
    assert sum(len(x.gaps) + len(x.counts) for x in stored.collect()) < 2.5 * sum(len(c) for c, _ in terms)


def test_lexical_weights_against_numpy(spark):
    """The same descent over a plain matrix, with terms cut one by one, gives the same weights."""
    import zlib

    import numpy as np

    from varve.operators import models

    rows = [(" ".join(f"{['der', 'the', 'le'][i % 3]}{(i * k) % 7} w{i % 5}" for k in range(i % 9)) + "z" * (i % 2 * 400), ["de", "en", "fr"][i % 3]) for i in range(60)]
    size = 2 * models.WORDS + len(models.LENGTHS) * models.RUNS
    counts = np.zeros((len(rows), size))
    for n, (text, _) in zip(counts, rows):
        words = text.lower().split()
        for term in words:
            n[zlib.crc32(term.encode()) % models.WORDS] += 1
        for a, b in zip(words, words[1:]):
            n[models.WORDS + zlib.crc32(f"{a} {b}".encode()) % models.WORDS] += 1
        for at, length in enumerate(models.LENGTHS):
            for i in range(len(text) - length + 1):
                code = 0
                for c in text.lower()[i : i + length]:
                    code = (code * 0x9E3779B97F4A7C15 + ord(c) + 1) % (1 << 64)
                n[2 * models.WORDS + at * models.RUNS + (code >> 40) % models.RUNS] += 1
    seen = (counts > 0).sum(axis=0)
    x = counts * np.where(seen >= 2, np.log((len(rows) + 1) / (seen + 1)), 0.0)
    x = np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones((len(rows), 1))])
    sign = np.where(np.array([["de", "en", "fr"].index(l) for _, l in rows])[:, None] == np.arange(3), 1.0, -1.0)

    def loss(w):
        short = np.maximum(0.0, 1 - sign * (x @ w))
        return ((short**2).sum() + 0.5 * (w**2).sum()) / len(rows), (w - 2 * x.T @ (sign * short)) / len(rows)

    model = models.lexical(spark.createDataFrame(rows, "text string, lang string").repartition(3), "lang")
    assert model.labels == ["de", "en", "fr"]
    assert model.weights == pytest.approx(models._descend(loss, np.zeros((size + 1, 3))), abs=1e-6)


def test_folds_deal_each_class_in_turn(spark):
    import hashlib

    from varve.operators import labels

    rows = [(i, "ab"[i % 3 == 0]) for i in range(500)] + [(1000 + i, None) for i in range(7)]
    found = labels.folds(spark.createDataFrame(rows, "k long, c string"), "c", "k", 5).collect()
    expected = {}
    for c in ("a", "b", None):
        for n, k in enumerate(sorted((k for k, x in rows if x == c), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())):
            expected[k] = n % 5
    assert {r.k: r.fold for r in found} == expected and len(found) == 507


def test_too_many_categories_are_an_error(spark):
    v = spark.range(5_001).select(F.col("id").alias("code"), F.array(F.lit(1.0)).alias("vector"))
    with pytest.raises(ValueError, match="5000"):
        evidence.cosine(v.withColumnRenamed("code", "item"), v)


@pytest.mark.parametrize("named", [10_000, 1])
def test_upserts_without_an_hour_lose_nothing(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(tiers, "HOURS_NAMED", named)
    path = str(tmp_path / "tier")
    for rows in ([(None, 1, 1), (3, 2, 1), (4, 3, 1), (9, 9, 1)], [(None, 5, 1), (4, 3, 2), (3, 7, 1)]):
        tiers.upsert_hours(spark, path, _late(spark, rows), ["ts_ns"], ["series_id"])
    found = {(r.epoch_hour, r.ts_ns, r.series_id) for r in spark.read.parquet(path).collect()}
    assert found == {(None, 1, 1), (None, 5, 1), (3, 2, 1), (3, 7, 1), (4, 3, 2), (9, 9, 1)}


@pytest.mark.parametrize("how", ["head", "frequent", "random"])
def test_sample_of_long_values_is_exact(spark, how):
    same = "x" * 150  # longer than what is counted of a value, so these tie until they are read whole
    values = [same + c for c in "dbbac"] + ["é" * 60 + c for c in "zay"] + ["short", "short", "", None, "y" * 100, "y" * 101, "y" * 101]
    rows = [("t", "long", v) for v in values] + [("t", "few", v) for v in ("b", "a", "b", None)] + [("u", "none", None)]
    counts = {}
    for t, c, v in rows:
        if v:
            counts[t, c, v] = counts.get((t, c, v), 0) + 1
    order = {"head": lambda v, n: v.encode(), "frequent": lambda v, n: (-n, v.encode()), "random": lambda v, n: hashlib.md5(("s" + v).encode()).hexdigest()}[how]
    for most in (2, 5, 20):
        expected = set()
        for t, c in {(t, c) for t, c, _ in counts}:
            own = sorted(((v, n) for (a, b, v), n in counts.items() if (a, b) == (t, c)), key=lambda x: order(*x))
            expected |= {(t, c, v, n, i) for i, (v, n) in enumerate(own[:most], 1)}
        got = profile.sample(spark.createDataFrame(rows, "source_table string, column_name string, value string"), most, how, "s" if how == "random" else "")
        assert {(r.source_table, r.column_name, r.value, r.n, r.place) for r in got.collect()} == expected


@pytest.mark.parametrize("how", ["head", "frequent", "random"])
def test_sample_of_tables_equals_that_of_cells(spark, monkeypatch, how):
    """Values are counted in their own types; few rows give bounds, and no value within them is lost."""
    from pyspark.sql.types import DecimalType

    monkeypatch.setattr(profile, "BOUND_ROWS", 20)
    made = spark.range(400).selectExpr(
        "id * 7 % 400 - 50 AS k", "int(id % 3) AS few", "IF(id % 5 = 0, NULL, repeat(string(id * 13 % 100), 60)) AS wide", "IF(id % 2 = 0, '', string(id)) AS s", "IF(id % 4 = 0, -0.0D, id / 8) AS d",
        "CAST(id / 8 AS decimal(18, 2)) AS m", "date_add(DATE'2020-02-27', int(id % 9)) AS day", "TIMESTAMP'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 4) AS at", "CAST(NULL AS int) AS none", "id % 2 = 0 AS yes",
    )
    tables = {"t": made.repartition(3), "u": made.select("few", "s").where("few > 0"), "empty": made.where("false")}
    cells = reduce(DataFrame.unionByName, (profile.cells(df, t) for t, df in tables.items()))
    for most in (3, 12):
        expected, got = (f(x, most, how, "s").select("source_table", "column_name", "value", "n", "place") for f, x in ((profile.sample, cells), (profile.sample_tables, tables)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert sorted(map(tuple, profile.null_ratio_tables(tables).select(*profile.KEY, "null_ratio").collect())) == sorted(map(tuple, profile.null_ratio(cells).collect()))
    doubles = spark.sql("SELECT * FROM VALUES (1.5D), (NULL), (-0.0D), (2.25D) AS v(d)")
    assert [r.null_ratio for r in profile.null_ratio_tables({"v": doubles}, {"d": DecimalType(18, 2)}).collect()] == [0.25]


@pytest.mark.parametrize("name", ["f01_sample_random", "b13_embedding_text", "b14_short_text", "b15_discrete_vector"])
def test_cells_are_not_printed_before_they_are_counted(spark, sf, monkeypatch, name):
    from varve import registry

    monkeypatch.setattr(profile, "cells", lambda df, t: pytest.fail("all cells as strings") if t == "lineitem" else cells_of(df, t))
    assert registry.queries()[name](spark, sf).count() > 40


cells_of = profile.cells


def test_pair_sharing_keeps_all_mass(spark):
    rows = [(1, "s", "a", 0.4), (1, "s", "b", 0.15), (1, "s", "b", 0.15), (1, "s", "*", 0.3), (2, "s", "a", 0.9), (2, "s", "*", 0.1), (3, "s", "*", 1.0), (4, "s", "b", 0.3), (4, "s", "c", 0.3), (4, "s", "*", 0.4)]
    known = spark.createDataFrame([("a", "b")], "a string, b string")
    got = evidence.share_with_pairs(spark.createDataFrame(rows, "item long, source string, focal string, mass double"), known)
    sums = {}
    for r in got.collect():
        sums[r.item, r.focal] = sums.get((r.item, r.focal), 0) + r.mass
    assert sums == pytest.approx({(1, "a"): 0.4, (1, "b"): 0.15, (1, "a|b"): 0.15, (1, "*"): 0.3, (2, "a"): 0.9, (2, "*"): 0.1, (3, "*"): 1.0, (4, "b"): 0.3, (4, "c"): 0.3, (4, "*"): 0.4})


@pytest.mark.parametrize("nodes", [{}, {"left": "abc", "right": "def", "all": "abcdef", "one": "a", "two": "de"}])
def test_decisions_from_masses_equal_those_from_intervals(spark, nodes):
    frame = evidence.Frame("abcdef", nodes, [("a", "b")])
    rows = [(1, "a", 0.4), (1, "b", 0.3), (1, "*", 0.3), (2, "*", 1.0), (3, "c", 0.25), (3, "b", 0.25), (3, "*", 0.5), (4, "a|b", 0.8), (4, "f", 0.1), (4, "*", 0.1), (5, "f", 1.0)]
    if nodes:
        rows += [(6, "left", 0.9), (6, "*", 0.1), (7, "right", 0.5), (7, "e", 0.2), (7, "a", 0.3)]
    fused = spark.createDataFrame([(i, f, m, 0.25 if i == 3 else 0.1) for i, f, m in rows], "item long, focal string, mass double, conflict double")
    expected = {r.item: r for r in evidence.decide(evidence.intervals(fused, frame)).collect()}
    assert {r.item: r for r in evidence.decide_fused(fused, frame).collect()} == expected
    assert len(expected) == (7 if nodes else 5)
    assert expected[2].code == "a" and expected[3].code == "b" and expected[3].needs_clarification


def test_decisions_in_small_frames(spark):
    fused = spark.createDataFrame([(1, "*", 1.0, 0.0), (2, "a", 0.6, 0.0), (2, "*", 0.4, 0.0)], "item long, focal string, mass double, conflict double")
    lone = evidence.Frame("a")
    got = evidence.decide_fused(fused, lone)
    assert {r.item: (r.code, r.confidence) for r in got.collect()} == {1: ("a", 1.0), 2: ("a", 1.0)}
    assert sorted(got.collect()) == sorted(evidence.decide(evidence.intervals(fused, lone)).collect())
    assert evidence.decide_fused(fused, evidence.Frame("")).count() == 0


@pytest.mark.parametrize("name", ["b13_typed_text", "b14_typed_text"])
def test_typed_texts_ask_for_no_null_ratio(spark, sf, monkeypatch, name):
    """Their texts don't have it, so all cells aren't read for it once more."""
    from varve import registry
    from varve.operators import profile

    monkeypatch.setattr(profile, "null_ratio", None)
    assert registry.queries()[name](spark, sf).count() == 49


def test_words_become_flags_of_their_item_before_a_shuffle(spark, sf):
    from varve import registry

    plan = registry.queries()["d09_pattern_mass"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max(RLIKE(w") >= 5


def test_a_landed_hour_is_one_file(spark, tmp_path):
    """Tasks times hours would be written otherwise."""
    from varve.operators.keyed import KeyedTier

    rows = spark.range(4_000).selectExpr("id AS k", "0 AS seq", "id % 10 AS epoch_hour")
    tier = KeyedTier(spark, str(tmp_path / "keyed"), ["k"], ["seq"], rows.schema, buckets=4)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        tier.land(rows, 1)
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert len(list((tmp_path / "keyed" / "rows").rglob("*.parquet"))) == 10 and tier.rows().count() == 4_000
