import numpy as np
import pytest

from seqframe.operators import cluster


def points(spark, n, kinds=4):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3)) + 6 * rng.integers(0, 2, (n, 1))
    y = rng.integers(-1, kinds, n)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "seq_id long, features array<double>, cluster int"), x, y


def test_more_points_than_a_matrix_takes(spark):
    table, x, y = points(spark, cluster.MOST + 200)
    d = cluster.distances(x)
    np.fill_diagonal(d, np.inf)
    got = {(r.seq_id, r["rank"]): r.distance for r in cluster.neighbours(table, 2).collect()}
    want = np.partition(d, 1, axis=1)[:, :2]
    assert len(got) == 2 * len(x)
    np.testing.assert_allclose([[got[i, 1], got[i, 2]] for i in range(len(x))], want, atol=1e-6)
    np.fill_diagonal(d, 0)
    got = {r.seq_id: r.silhouette for r in cluster.silhouettes(table).collect()}
    assert set(got) == set(np.flatnonzero(y >= 0).tolist())
    for i in list(got)[::50]:
        mean = [d[i, y == c].sum() / ((y == c).sum() - (c == y[i])) for c in range(4)]
        a, b = mean[y[i]], min(m for c, m in enumerate(mean) if c != y[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)


def test_blocks_agree(spark):
    table, x, _ = points(spark, 300)
    for block in (300, 70):
        near = {(r.seq_id, r["rank"], r.near) for r in cluster.neighbours(table, 3, block=block).collect()}
        assert near == {(r.seq_id, r["rank"], r.near) for r in cluster.neighbours(table, 3, block=10_000).collect()} and len(near) == 900
    for eps, least in ((0.6, 5), (1.2, 4)):
        got = {r.seq_id: r.cluster for r in cluster.dbscan_blocks(table, eps, least, block=70).collect()}
        assert [got[i] for i in range(300)] == cluster.dbscan(x, eps, least).tolist()


@pytest.mark.parametrize("method", ["dbscan", "hdbscan", "optics", "birch", "meanshift", "affinity", "spectral"])
def test_every_method_labels_all_points(spark, monkeypatch, method):
    monkeypatch.setattr(cluster, "MOST", 40)
    table, _, _ = points(spark, 120)
    assert len({r.seq_id for r in cluster.cluster(table.drop("cluster"), method, 3).collect()}) == 120


def test_silhouettes_in_wide_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)) + 1000
    x = np.concatenate([x, x[:20], x[:20] + 1e-7])
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(cluster._exact(x, x), want, rtol=1e-7, atol=1e-12)
    seen, met = [], cluster._met
    monkeypatch.setattr(cluster, "_met", lambda *a, **k: seen.append(k["block"]) or met(*a, **k))
    monkeypatch.setattr(cluster, "BLOCK", 2)
    table, _, _ = points(spark, 320)
    n = table.where("cluster >= 0").count()
    assert cluster.silhouettes(table).count() == n and seen == [-(-n // 16)]
