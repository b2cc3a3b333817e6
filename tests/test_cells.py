import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.operators import cluster, stats
from seqframe.operators.cells import FOLD, WIDE, Bounds, Cells, Near, _blocks, distances


def blobs(n, kinds=12, size=4, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, size)) + 40 * rng.normal(size=(kinds, size))[rng.integers(0, kinds, n)]


def table_of(spark, x, start=0):
    return spark.createDataFrame([(i + start, v.tolist()) for i, v in enumerate(x)], "seq_id long, features array<double>")


def brute(x, y, k, same=False):
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    if same:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("kind", ["blobs", "copies", "lattice"])
def test_neighbours_equal_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = {"blobs": blobs(700), "copies": np.concatenate([np.ones((250, 4)), blobs(300), blobs(300)]), "lattice": rng.integers(0, 4, (600, 3)).astype(float)}[kind]
    order, d = brute(x, x, 3, same=True)
    got = {(r.seq_id, r["rank"]): (r.near, r.distance) for r in cluster.neighbours(table_of(spark, x), 3, block=64).collect()}
    assert len(got) == 3 * len(x)
    for i in range(len(x)):
        assert [got[i, k + 1][0] for k in range(3)] == order[i].tolist(), i
        np.testing.assert_allclose([got[i, k + 1][1] for k in range(3)], d[i], atol=1e-9)


def test_nearest_representative_has_no_limit(spark):
    x, reps = blobs(400), np.concatenate([blobs(5_500, seed=2), blobs(5, seed=3), blobs(5, seed=3)])
    order, d = brute(x, reps, 1)
    got = {r.seq_id: (r.rep, r.distance) for r in cluster.nearest_representative(table_of(spark, x), table_of(spark, reps)).collect()}
    assert [got[i][0] for i in range(400)] == order[:, 0].tolist()
    np.testing.assert_allclose([got[i][1] for i in range(400)], d[:, 0], atol=1e-9)


def test_few_pairs_are_compared(spark):
    seen = []
    assert cluster.neighbours(table_of(spark, blobs(6_000, kinds=40)), 2, block=256, seen=seen).count() == 12_000
    assert 0 < seen[0].share() < 0.3


def sphere(n, size=64, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_vectors_without_structure_meet_in_blocks(spark):
    """A vector is sent to a bounded number of blocks, not to each ring."""
    x, seen = sphere(1_500), []
    order, d = brute(x, x, 3, same=True)
    got = {(r.seq_id, r["rank"]): (r.near, r.distance) for r in cluster.neighbours(table_of(spark, x), 3, block=128, seen=seen).collect()}
    assert seen[0].met and len(got) == 4_500
    assert [[got[i, k + 1][0] for k in range(3)] for i in range(1_500)] == order.tolist()
    np.testing.assert_allclose([[got[i, k + 1][1] for k in range(3)] for i in range(1_500)], d, atol=1e-12)
    assert [_blocks(n, 2_048) for n in (0, 2_048, 10_256, 51_282, FOLD * WIDE)] == [1, 1, 6, FOLD, FOLD]


def test_single_precision_bounds_hold():
    for x in (sphere(300), 1e6 + sphere(300), 1e-20 * sphere(300), 1e25 * sphere(300), np.ones((5, 3))):
        near, y = Near(x, x[:40]), x[:40]
        real = ((x[:, None] - y[None]) ** 2).sum(2) / near.scale**2 - near.size_x[:, None]
        got = np.concatenate([square for _, square in near.steps()])
        assert (np.abs(real - got) <= near.off[:, None]).all()


def test_bounds_hold():
    """No ring is left out that has a point within the bound."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        y, x = rng.normal(size=(300, 3)), rng.normal(size=(40, 3)) * 2
        pivots = y[:9]
        cell = distances(y, pivots).argmin(1)
        away = np.sqrt(((y - pivots[cell]) ** 2).sum(1))
        ring = cell * 2 + (away > 0.8)
        kinds = np.unique(ring)
        b = Bounds(pivots, *(np.array([f(k) for k in kinds]) for f in (lambda k: k // 2, lambda k: away[ring == k].min(), lambda k: away[ring == k].max(), lambda k: (ring == k).sum())))
        d, real = distances(x, pivots), distances(x, y)
        bound = rng.uniform(0, 2, 40)
        went = set(zip(*(v.tolist() for v in b.rings(d, bound)), strict=True))
        need = {(i, int(np.searchsorted(kinds, ring[j]))) for i, j in zip(*np.nonzero(real <= bound[:, None]), strict=True)}
        assert need <= went and len(went) < 40 * len(kinds)
        for k in (1, 5, 299):
            assert (np.sort(real, axis=1)[:, k - 1] <= b.reach(d, k) + 1e-9).all()
        assert np.isinf(b.reach(d, 301)).all()


def test_small_and_odd_tables(spark):
    none = table_of(spark, np.zeros((0, 2)))
    assert cluster.neighbours(none, 1).count() == 0
    one = table_of(spark, np.zeros((1, 2)))
    assert cluster.neighbours(one, 1).count() == 0
    assert cluster.nearest_representative(one, none).count() == 0
    assert [tuple(r) for r in cluster.nearest_representative(one, table_of(spark, np.array([[3.0, 4.0]]), 7)).collect()] == [(0, 7, 5.0)]
    same = table_of(spark, np.zeros((30, 2)))
    assert {(r.seq_id, r["rank"], r.near) for r in cluster.neighbours(same, 2).collect()} == {(i, k + 1, [j for j in range(3) if j != i][k]) for i in range(30) for k in range(2)}


def test_quantile(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=3000), np.repeat([1.0, 5.0, 9.0], 1000), rng.lognormal(sigma=6, size=3000), np.array([2.0])):
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        for q in (0.0, 0.5, 0.9, 1.0):
            assert stats.quantile(rows, "v", q, most=50, slots=20) == pytest.approx(np.quantile(x, q))
    assert stats.quantile(rows.limit(0), "v", 0.5) is None
    assert Cells(table_of(spark, np.zeros((3, 1)))).whole and F is not None
