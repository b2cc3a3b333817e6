"""Mean shift and optics take all points at any size, and give what their small forms give."""

import numpy as np
import pytest

from seqframe.operators import cluster
from test_cells import blobs, sphere, table_of
from test_density import labels_of

KINDS = {
    "blobs": lambda: np.concatenate([blobs(330, kinds=9, size=3), np.random.default_rng(4).uniform(-60, 60, (40, 3))]),
    "loose": lambda: np.random.default_rng(2).normal(size=(300, 2)) * np.random.default_rng(3).choice([0.2, 1, 4], (300, 1)),
    "copies": lambda: np.concatenate([blobs(150, kinds=5, size=3), blobs(150, kinds=5, size=3)[::3].repeat(2, axis=0), np.ones((40, 3))]),
    "sphere": lambda: sphere(300, 8),
}


@pytest.mark.parametrize(("kind", "width", "block"), [("loose", 0.7, 60), ("copies", 1.3, 60)])
def test_mean_shift_equals_the_small_form(spark, kind, width, block):
    x = KINDS[kind]()
    got = labels_of(cluster.mean_shift_rounds(table_of(spark, x), width, block=block), len(x))
    assert got == cluster.mean_shift(x, width).tolist() and max(got) > 1


@pytest.mark.parametrize(("kind", "least", "block"), [("blobs", 2, 60), ("loose", 13, 5_000), ("copies", 4, 60), ("sphere", 4, 60)])
def test_optics_equals_the_small_form(spark, kind, least, block):
    x = KINDS[kind]()
    got = labels_of(cluster.optics_tree(table_of(spark, x), least, block=block), len(x))
    assert got == cluster.optics(x, least).tolist()


@pytest.mark.parametrize("method", ["meanshift", "optics"])
def test_no_switch_by_size(spark, monkeypatch, method):
    """Beyond MOST points there were representatives, and so other labels."""
    table = table_of(spark, KINDS["blobs"]())
    want = labels_of(cluster.cluster(table, method), 370)
    monkeypatch.setattr(cluster, "MOST", 60)
    monkeypatch.setattr(cluster, "reduced", None)
    assert labels_of(cluster.cluster(table, method), 370) == want


def test_few_points(spark):
    for n in (0, 1, 5):
        table = table_of(spark, sphere(n, 3))
        assert len(labels_of(cluster.mean_shift_rounds(table, 0.5), n)) == n
        assert labels_of(cluster.optics_tree(table, 2), n) == (cluster.optics(sphere(n, 3), 2).tolist() if n else [])
