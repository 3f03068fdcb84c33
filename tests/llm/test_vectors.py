"""Whitening, hard negatives and nearest neighbours against brute force and on odd tables."""

import math

import numpy as np
import pytest
from compare import DATA, assert_same

from varve.llm import hard_negatives, queries, vantage, vectors, whitening
from varve.llm.hard_negatives import SortedLists, Wanted
from varve.llm.vantage import VantageTree

SCHEMA = "vec_id long, embedding array<float>, label int, x string, index int, vector string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1, "clash", 2) for i, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, bad entries, zeros, copies of one vector, repeated rows and a null id."""
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist(), i % 3) for i in range(200)]
    rows += [(300 + i, [0.5, 0.25, 0.0, -1.0, 0.125, 2.0], 1) for i in range(80)]
    rows += [(400, None, 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (402, [math.nan] + [0.0] * 5, 1), (403, [math.inf] + [0.0] * 5, 1), (404, [0.0] * 6, 0), (405, r.normal(size=6).tolist(), None)]
    rows += [rows[100], rows[100], (None, rows[7][1], 1)]
    return table(spark, rows)


def usable(df):
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    return [(i, np.array(v, dtype=float), label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def whitening_matches(df):
    rows = usable(df)
    x = np.array([np.floor(64 * v) + 1_000_000 for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, x.shape[1])
    found = whitening.whitened(df).collect()
    assert len(found) == len(rows) * k
    expected = sorted((str(i), int(((n * v - s) ** 2).sum()), tuple(np.abs((v - s / n) @ u[:, :k] / np.sqrt(e[:k])).round(6))) for (i, _, _), v in zip(rows, x))
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation, r.component), []).append(abs(r.whitened))
        assert r.n == n and abs(r.explained - e[r.component - 1] / np.trace(covariance)) < 1e-9 and r.identity_error < 1e-9
    got = sorted((str(i), d, c, round(v, 6)) for (i, d, c), values in by.items() for v in values)
    assert len(got) == len(expected) * k
    np.testing.assert_allclose([g[3] for g in got], [v for *_, v in sorted((i, d, c + 1, w[c]) for i, d, w in expected for c in range(k))], atol=2e-6)


def test_whitening_equals_eigh(spark):
    whitening_matches(spark.read.parquet(f"{DATA}/embeddings.parquet"))


def test_whitening_of_odd_rows(odd, none):
    whitening_matches(odd)
    assert whitening.whitened(none).collect() == []


def test_whitening_in_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    whitening_matches(spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(5))


def test_whitening_without_variance_or_of_lower_rank(spark):
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    line = table(spark, [(i, [float(i), 2.0 * i, -float(i)], 0) for i in range(9)])
    found = whitening.whitened(line).collect()
    assert {r.component for r in found} == {1} and len(found) == 9 and found[0].identity_error < 1e-9 and abs(found[0].explained - 1) < 1e-9
    with pytest.raises(ValueError, match="entries"):
        whitening.whitened(table(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]))


def test_product_is_split(spark):
    """No task is handed all blocks: the parts of the middle dimension are summed."""
    df, rows, block, parts = whitening.placed(spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("cast(embedding AS array<double>) AS x").repartition(6))
    made = whitening.blocks(df, "x", rows, 64, block)
    assert parts == 6 and whitening.product(made.transpose(), made, parts).blocks.count() == 1
    local = np.array([r.x for r in df.collect()])
    np.testing.assert_allclose(whitening.scatter(made, parts), local.T @ local, rtol=1e-12)


# --- hard negatives


def test_hard_negatives_equal_sql(spark, sf):
    assert_same(queries.op12_threshold_negatives(spark, sf), queries.ORACLES["op12_threshold_negatives"], sf)


def brute_negatives(rows, anchors, positives=5, negatives=10):
    out = []
    for a in (r for r in rows if anchors(r[0])):
        scored = sorted((-int(v @ a[1]), i, label) for i, v, label in rows if i != a[0])
        for s, p, _ in [r for r in scored if r[2] == a[2]][:positives]:
            inside = [r for r in scored if r[2] != a[2] and -30 * s <= -100 * r[0] <= -90 * s][:negatives]
            out += [(a[0], p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(inside)]
    return sorted(out)


def one_each(rows):
    least = {}
    for i, v, label in sorted(((i, v, label) for i, v, label in rows if i is not None), key=lambda r: (r[0], r[2] if r[2] is not None else -1, list(r[1]))):
        least.setdefault(i, (i, v, label))
    return list(least.values())


def test_hard_negatives_of_odd_rows(odd, none):
    rows = one_each((i, np.floor(256 * v).astype(int), label) for i, v, label in usable(odd) if label is not None)
    ready = hard_negatives.integer_rows(odd)
    found = hard_negatives.mined(ready, ready.where("vec_id % 10 = 0"))
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)
    ready = hard_negatives.integer_rows(none)
    assert hard_negatives.mined(ready, ready).collect() == []


def test_hard_negatives_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROOT", 2)
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_BLOCK", 3)
    r = np.random.default_rng(3)
    df = table(spark, [(i, r.integers(-2, 3, 4).astype(float).tolist(), int(r.integers(0, 2))) for i in range(300)])
    ready = hard_negatives.integer_rows(df, scale=1)
    found = hard_negatives.mined(ready, ready.where("vec_id % 25 = 0"))
    assert sorted(map(tuple, found.collect())) == brute_negatives([(i, v.astype(int), label) for i, v, label in usable(df)], lambda i: i % 25 == 0)


@pytest.mark.parametrize("seed", range(6))
def test_threshold_search(seed):
    """Ties, zero anchors, windows that hold nothing, and an early stop where scores fall fast."""
    r = np.random.default_rng(seed)
    x = np.floor(r.pareto(1.0, (4000, 5)) * r.choice([-9, 9], (4000, 5))).astype(np.int64)
    ids = r.permutation(4000)
    lists = SortedLists(ids, x)
    for anchor in (x[0], np.zeros(5, np.int64), np.array([0, 0, -3, 0, 1])):
        among = r.random(4000) < 0.7
        scores = x @ anchor
        wanted = [Wanted(10), Wanted(5, 10, 200), Wanted(3, 7, 6), Wanted(4, int(scores.max()) + 1)]
        found, scored = lists.search(anchor, among, wanted)
        for w, (got, values) in zip(wanted, found):
            fine = among & (scores >= (w.low if w.low is not None else scores.min())) & (scores <= (w.high if w.high is not None else scores.max()))
            expected = sorted(zip(-scores[fine], ids[fine]))[: w.k]
            assert list(zip(-values, got)) == expected
    only, scored = lists.search(x[np.abs(x).max(axis=1).argmax()], np.ones(4000, bool), [Wanted(3)])
    assert scored < 2000


def test_large_integers_are_exact_or_an_error():
    x = np.array([[1 << 28, 1], [1 << 28, 0], [-(1 << 28), 5]])
    (found,), _ = SortedLists(np.arange(3), x).search(np.array([1 << 28, 1]), np.ones(3, bool), [Wanted(3)])
    assert found[0].tolist() == [0, 1, 2] and found[1].tolist() == [(1 << 56) + 1, 1 << 56, -(1 << 56) + 5]
    with pytest.raises(OverflowError):
        SortedLists(np.arange(1), np.array([[1 << 40]])).search(np.array([1 << 40]), np.ones(1, bool), [Wanted(1)])


# --- nearest neighbours


def brute_nearest(rows, asked, k=20):
    out = []
    for i, q in ((i, v) for i, v, _ in rows if asked(i)):
        scored = sorted((-float((q * v).sum()), j) for j, v, _ in rows if j != i)[:k]
        out += [(i, n + 1, j) for n, (_, j) in enumerate(scored)]
    return sorted(out)


def test_factor_one_is_exact_with_copies_and_all_norms(odd, none):
    rows = [r for r in one_each(usable(odd)) if r[1].any()]
    ready = vantage.searchable(odd)
    found = vantage.nearest(ready, ready.where("vec_id % 20 = 0"), factor=1.0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == brute_nearest(rows, lambda i: i % 20 == 0)
    by = {i: v for i, v, _ in rows}
    assert all(r.score == float((by[r.query_id] * by[r.vec_id]).sum()) for r in found)
    ready = vantage.searchable(none)
    assert vantage.nearest(ready, ready).collect() == []


def test_fewer_candidates_than_asked_for(spark):
    ready = vantage.searchable(table(spark, [(20, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [-1.0, 0.0], 0), (3, [0.0, 0.0], 0)]))
    found = vantage.nearest(ready, ready.where("vec_id % 20 = 0")).collect()
    assert [tuple(r) for r in sorted(found)] == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]


def test_recall_of_the_query(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    expected = {(i, j) for i, _, j in brute_nearest(usable(df), lambda i: i % 20 == 0)}
    found = queries.op13_vantage_trees(spark, sf).collect()
    assert len(found) == len(expected) and len({(r.query_id, r.vec_id) for r in found} & expected) >= 0.95 * len(expected)


def test_trees_prune_where_there_is_structure():
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 8)) * 10
    x = (centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 8)) * 0.1).astype(np.float32).astype(float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    tree = VantageTree(np.arange(3000), x)
    who, places, scores, scored = tree.search(x[:50], np.arange(50), 5)
    found = {q: set(tree.ids[places[who == q]]) for q in range(50)}
    for q in range(50):
        s = x @ x[q]
        s[q] = -np.inf
        assert set(np.argsort(-s)[:5]) <= found[q]
    assert scored < 0.5 * 50 * 3000
    assert tree.search(x[:50], np.arange(50), 5, factor=4.0)[3] < scored
