import numpy as np
import pytest

from seqframe.operators import cluster
from seqframe.operators.features import Tree
from test_cells import blobs, table_of


def held(tree):
    n, mean, s = tree.leaves()
    return n.sum(), n @ mean, s.sum() + n @ (mean**2).sum(1), np.sqrt(s / n)


@pytest.mark.parametrize(("n", "most"), [(1, 50), (3_000, 60), (3_000, 5_000)])
def test_a_tree_holds_all_points_within_its_radius(n, most):
    x = blobs(n, kinds=7)
    tree = Tree(4, 0.8, most)
    for p in x:
        tree.add(1.0, p, 0.0)
    total, sums, squares, radius = held(tree)
    assert total == n and np.allclose(sums, x.sum(0)) and np.isclose(squares, (x**2).sum())
    assert (radius <= tree.threshold + 1e-9).all() and len(radius) == tree.features <= most
    assert tree.threshold == 0.8 or most == 60


def test_copies_are_one_feature():
    tree = Tree(2, 0.0, 10)
    for _ in range(500):
        tree.add(1.0, np.array([3.0, 4.0]), 0.0)
    assert tree.features == 1 and tree.leaves()[0].tolist() == [500]


def test_many_trees_like_one(spark):
    """Features of trees over shares: all points, radii within the stated threshold, and the clusters of one tree over all rows."""
    x = blobs(2_000, kinds=6, seed=3)
    table = table_of(spark, x)
    for fed in (100, 10_000):
        got = cluster.clustering_features(table, 1.0, most=150, fed=fed).collect()
        n, mean = np.array([r.n for r in got]), np.array([r["mean"] for r in got])
        assert n.sum() == 2_000 and np.allclose(n @ mean, x.sum(0)) and len(got) <= 150
        assert all(np.sqrt(r.s / r.n) <= max(r.threshold for r in got) + 1e-9 for r in got)
    one, many = ({r.seq_id: r.cluster for r in cluster.birch(table, 6, 1.0, most=150, fed=f).collect()} for f in (10_000, 100))
    pairs = {(one[i], many[i]) for i in range(2_000)}
    assert len(one) == len(many) == 2_000 and len(pairs) == 6
    assert cluster.birch(table.limit(0), 3, 1.0).count() == 0
