import numpy as np
import pytest

from seqframe.operators import cluster
from test_cells import blobs, sphere, table_of


def labels_of(found, n):
    got = {r.seq_id: r.cluster for r in found.collect()}
    assert len(got) == n
    return [got[i] for i in range(n)]


@pytest.mark.parametrize("block", [60, 5_000])
def test_dbscan_equals_the_small_form(spark, block):
    rng = np.random.default_rng(4)
    x = np.concatenate([blobs(350, kinds=6, size=3), np.ones((80, 3)), rng.uniform(-60, 60, (70, 3))])
    for eps, least in ((1.0, 5), (2.5, 10)):
        seen = []
        got = labels_of(cluster.dbscan_blocks(table_of(spark, x), eps, least, block=block, seen=seen), len(x))
        assert got == cluster.dbscan(x, eps, least).tolist() and max(got) > 2
    if block == 60:
        assert seen[0].share() < 0.5


def test_dbscan_in_blocks_equals_the_small_form(spark):
    x, seen = np.concatenate([sphere(500, 16), 0.6 * sphere(100, 16, seed=1), sphere(1, 16).repeat(20, axis=0)]), []
    got = labels_of(cluster.dbscan_blocks(table_of(spark, x), 0.75, 8, block=64, seen=seen), len(x))
    assert got == cluster.dbscan(x, 0.75, 8).tolist() and seen[0].met and -1 in got and max(got) >= 0


def test_dense_rings_are_core(spark):
    x = np.concatenate([np.random.default_rng(0).normal(scale=0.01, size=(300, 2)), [[50.0, 50.0], [0.4, 0.0]]])
    seen = []
    got = labels_of(cluster.dbscan_blocks(table_of(spark, x), 0.5, 5, block=50, seen=seen), 302)
    assert got == cluster.dbscan(x, 0.5, 5).tolist() == [0] * 300 + [-1, 0]
    assert seen[0].dense(0.5, 5)


@pytest.mark.parametrize(("n", "block", "k"), [(600, 100, 7), (40, 5_000, 3), (2_000, 500, 12)])
def test_ward_equals_the_small_form(spark, n, block, k):
    x = blobs(n, kinds=15, seed=9)
    got = labels_of(cluster.ward_clusters(table_of(spark, x), k, block=block), n)
    assert got == cluster.ward(x, k).tolist()


def test_ward_builds_no_cells_where_they_are_of_no_use(spark, monkeypatch):
    x, built, asked = sphere(500), [], []
    cells, meeting = cluster.Cells, cluster.meeting
    monkeypatch.setattr(cluster, "Cells", lambda *a, **k: built.append(1) or cells(*a, **k))
    monkeypatch.setattr(cluster, "meeting", lambda *a, **k: asked.append(a[2:4]) or meeting(*a, **k))
    got = labels_of(cluster.ward_clusters(table_of(spark, x), 5, block=250), 500)
    assert got == cluster.ward(x, 5).tolist() and len(built) == 1 and asked and all(few < n for few, n in asked)


def test_ward_merges_copies_first(spark):
    x = np.concatenate([np.zeros((90, 2)), np.ones((60, 2)), [[9.0, 9.0]]])
    merges = cluster.ward_joins(table_of(spark, x), block=2).collect()
    assert len(merges) == 150 and sum(m.height == 0 for m in merges) == 148 and all(m.a < m.b for m in merges)
    assert labels_of(cluster.ward_clusters(table_of(spark, x), 3, block=2), 151) == [0] * 90 + [1] * 60 + [2]
    assert labels_of(cluster.ward_clusters(table_of(spark, x), 500), 151) == list(range(151))
    assert cluster.ward_clusters(table_of(spark, x[:0]), 3).count() == 0
    assert labels_of(cluster.ward_clusters(table_of(spark, x[:1]), 3), 1) == [0]


def test_tiers(spark):
    x = blobs(300, kinds=4, seed=1)
    for large in (200, 20_000):
        got = labels_of(cluster.ward_tiered(table_of(spark, x), 4, large=large), 300)
        assert len(set(got)) == 4
