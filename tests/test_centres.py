import numpy as np
import pytest

from seqframe.operators import centres, cluster
from test_cells import blobs, table_of


def test_representatives_do_not_depend_on_how_rows_are_dealt(spark):
    """Spark ML's seeds, taken before, follow the partitions."""
    table = table_of(spark, blobs(900, kinds=9))
    some = [{r.seq_id for r in cluster.reduced(table.repartition(n), 60).collect()} for n in (1, 5)]
    assert some[0] == some[1] and 50 <= len(some[0]) <= 60


def test_centres_like_a_plain_program(spark):
    x = blobs(700, kinds=9)
    table = table_of(spark, x)
    start = centres.seeds(table, 40, key="seq_id")
    assert start.shape == (40, x.shape[1])
    got, want = centres.centres_of(table, 40, key="seq_id", rounds=3), start
    for _ in range(3):
        at = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
        want = np.array([x[at == c].mean(0) if (at == c).any() else want[c] for c in range(40)])
    np.testing.assert_allclose(got, want, atol=1e-9)
    away = ((x[:, None] - want[None]) ** 2).sum(2)
    for r in centres.placed(table, want, key="seq_id").collect():
        i = np.flatnonzero((x == np.array(r.features)).all(1))[0]
        assert r.place == away[i].argmin() and np.isclose(r.away**2, away[i].min())
    _, other = cluster.kmeans(table, 40)
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    assert cost(centres.centres_of(table, 40, key="seq_id")) <= 1.1 * cost(other)


def test_fewer_vectors_than_centres(spark):
    """Copies are no centres of their own; a table of copies only has one."""
    x = np.repeat(blobs(20), 5, axis=0)
    table = table_of(spark, x)
    got = centres.centres_of(table, 40, key="seq_id")
    away = ((got[:, None] - x[None, ::5]) ** 2).sum(2)
    assert 10 <= len(got) <= 20 and len(set(away.argmin(1).tolist())) == len(got)
    assert len(centres.centres_of(table_of(spark, x[:1].repeat(30, axis=0)), 4, key="seq_id")) == 1


@pytest.mark.parametrize("method", ["meanshift", "optics"])
def test_labels_of_reduced_points_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch, method):
    monkeypatch.setattr(cluster, "MOST", 60)
    table = table_of(spark, blobs(900, kinds=40))
    got = [{tuple(r) for r in cluster.cluster(table.repartition(n), method).collect()} for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 900


def test_modes_like_a_plain_loop():
    x = np.random.default_rng(6).normal(size=(300, 2))
    at = x.copy()
    for _ in range(100):
        near = np.linalg.norm(at[:, None] - x[None], axis=2) <= 0.4
        at, before = np.array([x[n].mean(0) for n in near]), at
        if np.abs(at - before).max() < 0.4e-3:
            break
    full, modes = (np.linalg.norm(at[:, None] - x[None], axis=2) <= 0.4).sum(1), []
    for i in np.argsort(-full, kind="stable"):
        if all(np.linalg.norm(at[i] - c) > 0.4 for c in modes):
            modes.append(at[i])
    assert 1 < len(modes) and cluster.mean_shift(x, 0.4).tolist() == np.linalg.norm(x[:, None] - np.array(modes)[None], axis=2).argmin(1).tolist()
