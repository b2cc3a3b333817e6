"""Clustering of feature tables: key and features array<double>; keys are unique.

k-means, mixtures and power iteration are Spark ML's. Nearest neighbours, silhouettes and
DBSCAN are exact at any size: blocks of about BLOCK rows meet each other in groups.
Other methods that need a distance matrix (Ward, density trees, affinity propagation and
others) run in numpy over a reduced sample of at most MOST points, as the methods' cost asks
for; all other points then get the label of the nearest representative. Labels count from 0,
noise is -1.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqframe.functions.sequence import distance
from seqframe.operators.cells import Cells, Near, matrix, meeting, nearest, place_of, rank_of, squares, where
from seqframe.operators.cells import distances as between
from seqframe.operators.centres import centres_of, placed
from seqframe.operators.features import MOST_FEATURES, Tree
from seqframe.operators.pairs import numbered
from seqframe.operators.stats import quantile, sample_of, standardized
from seqframe.scratch import settled

MOST = 5_000
BLOCK = 2_048  # rows of a block, about
_WIDE = 16_384  # the most of one where pairs are only summed up


def _with_vector(table: DataFrame) -> DataFrame:
    return table.withColumn("__x", array_to_vector(F.transform("features", lambda x: x.cast("double"))))


def kmeans(table: DataFrame, k: int, *, key: str = "seq_id", rounds: int = 20, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """key, cluster; and the centres."""
    fitted = KMeans(k=k, featuresCol="__x", predictionCol="cluster", maxIter=rounds, seed=seed).fit(_with_vector(table))
    return fitted.transform(_with_vector(table)).select(key, "cluster"), np.array(fitted.clusterCenters())


def mixture(table: DataFrame, k: int | None = None, *, key: str = "seq_id", seed: int = 42) -> DataFrame:
    """Gaussian mixture with full covariances; k by default min(max(2, sqrt(n) / 2), 10)."""
    k = k or min(max(2, int(table.count() ** 0.5 / 2)), 10)
    fitted = GaussianMixture(k=k, featuresCol="__x", predictionCol="cluster", seed=seed).fit(_with_vector(table))
    return fitted.transform(_with_vector(table)).select(key, "cluster")


def points_of(table: DataFrame, *, key: str = "seq_id") -> tuple[list, np.ndarray]:
    """A small table as ids and a matrix; more than MOST points are refused."""
    rows = table.select(key, "features").orderBy(key).limit(MOST + 1).toPandas()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} points; reduce the table first")
    return rows[key].tolist(), np.array(rows["features"].tolist(), float).reshape(len(rows), -1)


def _labelled(table: DataFrame, ids: list, labels: np.ndarray, key: str) -> DataFrame:
    kind = table.select(key).schema[0].dataType.simpleString()
    return table.sparkSession.createDataFrame([(i, int(c)) for i, c in zip(ids, labels, strict=True)], f"{key} {kind}, cluster int")


def distances(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    return between(x, x if y is None else y)


def ward_merges(x: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges by Ward's criterion from a nearest-neighbour chain, lowest first: a point
    of each side, and the height."""
    n = len(x)
    size = np.ones(n) if weight is None else weight.astype(float)
    centre, alive, chain, merges = x.astype(float).copy(), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            d = ((centre - centre[a]) ** 2).sum(1) * (2 * size * size[a] / (size + size[a]))
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(np.argmin(d))
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((a, b, float(np.sqrt(d[b]))))
        centre[b] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[b] += size[a]
        alive[a] = False
    return sorted(merges, key=lambda m: m[2])


def ward(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels from 0 in the order of first appearance; at most k of them."""
    root = list(range(len(x)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, _ in ward_merges(x, weight)[: max(0, len(x) - k)]:
        root[find(a)] = find(b)
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(len(x))], int)


def ward_joins(table: DataFrame, *, key: str = "seq_id", block: int | None = None) -> DataFrame:
    """a, b, height: the merges of Ward's criterion, as many as points but for one; a < b are
    the least keys of two clusters, which are a from then on. Ward's criterion is reducible: clusters that
    are each other's nearest may be merged in any order, so that a round merges all of them. A
    round is a join over Voronoi cells of the centres (cells.py), bounded by the criterion of a cluster nearby and
    the least size; centres and sizes merge by weighted means. Only new clusters and those whose nearest was
    merged look again: a merged cluster is no nearer to others than its parts were. Once blocks of all clusters cost less
    than cells, later rounds build none. Rounds go on until one chunk of clusters
    is left, which is a bounded number, and is merged in one place. Of equal heights the least keys go first."""
    kind = table.select(key).schema[0].dataType.simpleString()
    spark = table.sparkSession
    rows = table.select(key, F.transform("features", lambda v: v.cast("double")).alias("features"))
    points = settled(vectors(rows, key=key).withColumnRenamed("n", "size"))
    copies = rows.join(points.select("features", F.col(key).alias("a")), "features").where(F.col(key) != F.col("a"))
    merges = [settled(copies.select("a", F.col(key).alias("b"), F.lit(0.0).alias("height")))]
    now = points.select(key, "features", F.col("size").cast("double").alias("size"))
    schema = f"{key} {kind}, near {kind}, height double"

    def closest(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Asking rows, the other cluster and the height of the least merge."""
        same, rank = place_of(own.column(key), other.column(key)), rank_of(other.column(key))
        mine, theirs, out = own.column("size").to_numpy(), other.column("size").to_numpy(), []
        lone, others, near = (1 / mine).astype(np.float32), (1 / theirs).astype(np.float32), Near(x, y)
        off = 2 * near.off / (1 / mine + 1 / theirs.max())
        for some, square in near.steps():
            square += near.size_x[some, None].astype(np.float32)
            square /= lone[some, None] + others[None, :]
            held = np.flatnonzero(same[some] >= 0)
            square[held, same[some][held]] = np.inf
            least = np.maximum(square.min(axis=1).astype(float), 0)
            limit = (least * (1 + 1e-5) + 2 * off[some]).astype(np.float32)
            i, j = where(square <= np.nextafter(limit, np.float32(np.inf))[:, None])
            good = np.isfinite(square[i, j])
            i, j = some.start + i[good], j[good]
            height = np.sqrt(squares(x, i, y, j) * (2 * mine[i] * theirs[j] / (mine[i] + theirs[j])))
            order = np.lexsort((rank[j], height, i))
            new = order[np.diff(i[order], prepend=-1) != 0]
            out.append((i[new], j[new], height[new]))
        return tuple(np.concatenate(v) for v in zip(*out))

    def search(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        i, j, height = closest(own, x, other, y)
        return pa.table({key: own.column(key).take(pa.array(i)), "near": other.column(key).take(pa.array(j)), "height": height})

    def looked_up(asks: DataFrame, least: float, most: float) -> tuple[DataFrame, bool]:
        """Candidates for the nearest of asking clusters, and whether all met in blocks."""
        index = Cells(now, key=key, keep=("size",), block=block)
        away = lambda size, other: np.sqrt(2 * size * other / (size + other))  # noqa: E731  height over distance

        def bounds(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
            size, limit = own.column("size").to_numpy(), own.column("__bound").to_numpy()
            limit = limit * away(size, most)
            i, _, height = closest(own, x, other, y)
            limit[i] = np.minimum(limit[i], height)
            return pa.table({key: own.column(key), "features": own.column("features"), "size": own.column("size"), "bound": limit / away(size, least)})

        bounded = settled(index.join(asks, bounds, f"{key} {kind}, features array<double>, size double, bound double", near=2, home=True, keep=("size",)))
        return index.join(bounded, search, schema, bound=F.col("bound"), keep=("size",)), index.met

    known, blocks = None, False  # clusters whose nearest has not changed; whether cells are of no use
    while True:
        least, most, n = now.agg(F.min("size"), F.max("size"), F.count("*")).first()
        if n <= (block or BLOCK):
            break
        asks = now if known is None else settled(now.join(known.select(key), key, "left_anti"))
        if blocks:
            met = meeting(asks, now, asks.count(), n, search, schema, key=key, block=block)
        else:
            met, blocks = looked_up(asks, least, most)
        near = met.groupBy(key).agg(F.min(F.struct("height", F.col("near"))).alias("m")).select(key, "m.near", "m.height")
        near = settled(near if known is None else near.unionByName(known))
        back = near.select(F.col(key).alias("near"), F.col("near").alias(key))
        pairs = settled(near.join(back, [key, "near"]).where(F.col(key) < F.col("near")).select(F.col(key).alias("a"), F.col("near").alias("b"), "height"))
        if not pairs.limit(1).count():  # only if rounding breaks ties in a circle: the least merge goes alone
            pairs = settled(near.select(F.least(key, "near").alias("a"), F.greatest(key, "near").alias("b"), "height").orderBy("height", "a", "b").limit(1))
        merges.append(pairs)
        touched = pairs.select(F.explode(F.array("a", "b")).alias(key))
        known = near.join(touched, key, "left_anti").join(touched.select(F.col(key).alias("near")), "near", "left_anti").select(key, "near", "height")
        gone = now.join(pairs.select(F.col("b").alias(key), "a"), key)
        moved = gone.select(F.col("a").alias(key), F.col("features").alias("f2"), F.col("size").alias("s2"))
        stays = now.join(pairs.select(F.col("b").alias(key)), key, "left_anti").join(moved, key, "left")
        mixed = F.zip_with("features", "f2", lambda u, v: (u * F.col("size") + v * F.col("s2")) / (F.col("size") + F.col("s2")))
        now = settled(stays.select(key, F.when(F.col("f2").isNull(), F.col("features")).otherwise(mixed).alias("features"), (F.col("size") + F.coalesce("s2", F.lit(0.0))).alias("size")))
    left = now.orderBy(key).toArrow()  # BLOCK rows at most
    names = left.column(key).to_pylist()
    root, rows = list(range(len(names))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if names:
        for i, j, height in ward_merges(matrix(left.column("features")), left.column("size").to_numpy()):
            i, j = sorted((find(i), find(j)))
            root[j] = i
            rows.append((names[i], names[j], height))
    merges.append(spark.createDataFrame(rows, f"a {kind}, b {kind}, height double"))
    return reduce(DataFrame.unionAll, merges)


def ward_clusters(table: DataFrame, k: int, *, key: str = "seq_id", block: int | None = None) -> DataFrame:
    """key, cluster: the merges of ward_joins() but for the k - 1 highest; clusters count from 0 in
    the order of their least keys."""
    merges = settled(ward_joins(table, key=key, block=block))
    cut = merges.orderBy(F.desc("height"), "a", "b").limit(max(0, k - 1))
    kept = merges.join(cut.select("b"), "b", "left_anti")  # each key is merged into another one once
    up = settled(table.select(key).join(kept.select(F.col("b").alias(key), "a"), key, "left").select(key, F.coalesce("a", key).alias("root")))
    while True:  # pointers to a lesser key of the same cluster, doubled
        above = up.select(F.col(key).alias("root"), F.col("root").alias("above"))
        new = settled(up.join(above, "root").select(key, F.col("above"), "root"))
        changed = new.where(F.col("above") != F.col("root")).limit(1).count()
        up = new.select(key, F.col("above").alias("root"))
        if not changed:
            break
    return up.join(_counted(up), "root").select(key, "cluster")


def ward_tiered(table: DataFrame, k: int, *, key: str = "seq_id", large: int = 20_000, seed: int = 42) -> DataFrame:
    """Ward up to `large` points. Beyond, k-means with min(1000, n / 100) centres, Ward on
    the centres, and each point gets its centre's label by a join."""
    n = table.count()
    if n <= large:
        return ward_clusters(table, k, key=key)
    first, centres = kmeans(table, max(k, min(1000, n // 100)), key=key, seed=seed)
    sizes = {r["cluster"]: r["count"] for r in first.groupBy("cluster").count().collect()}  # one row to a centre
    labels = ward(centres, k, np.array([sizes.get(i, 1) for i in range(len(centres))]))
    names = table.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "cluster int, final int")
    return first.join(F.broadcast(names), "cluster").select(key, F.col("final").alias("cluster"))


def _met(table: DataFrame, run: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, *, key: str, keep: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """What run returns for each block of rows with each block of rows: it gets the asking
    rows and the others, both in the order of the key, each with its matrix."""
    blocks = max(1, -(-table.count() // (block or BLOCK)))
    share = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = table.select(share.alias("__a"), every.alias("__b"), F.lit(True).alias("__asks"), key, "features", *keep)
    right = table.select(every.alias("__a"), share.alias("__b"), F.lit(False).alias("__asks"), key, "features", *keep)
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        own, other = (group[group["__asks"] == asks].sort_values(key, ignore_index=True) for asks in (True, False))
        if not len(own) or not len(other):
            return pd.DataFrame(columns=names)
        return run(own, np.array(own["features"].tolist(), float), other, np.array(other["features"].tolist(), float))

    return left.union(right).groupBy("__a", "__b").applyInPandas(meet, schema)


def vectors(table: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """key, features, n: a row to each different vector, under the least key of its copies."""
    return table.groupBy("features").agg(F.min(key).alias(key), F.count("*").alias("n")).select(key, "features", "n")


def _first_keys(table: DataFrame, names: DataFrame, k: int, *, key: str) -> tuple[DataFrame, DataFrame]:
    """Every point with its vector's name, and of each vector the k least keys. A vector with
    many copies is dealt first."""
    own = settled(table.select(key, "features").join(names.select(F.col(key).alias("vector"), "features"), "features").select(key, "vector"))
    some = own.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(64)))
    for by in (["vector", "__s"], ["vector"]):
        some = some.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("__n") <= k)
    return own, some.select("vector", F.col(key).alias("near"))


def _k_nearest(index: Cells, asks: DataFrame, k: int, *, key: str, itself: bool) -> DataFrame:
    """key, near, distance: the k nearest rows of the index, the least key of equals. First a chunk
    nearby gives each asking point a bound, then all chunks within it are searched."""
    kind = asks.select(key).schema[0].dataType.simpleString()

    def found(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray):
        return nearest(x, y, rank_of(other.column(key)), k, place_of(own.column(key), other.column(key)) if itself else None)

    def bounds(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        i, _, d = found(own, x, other, y)
        many = np.bincount(i, minlength=len(x))
        far = np.zeros(len(x))
        np.maximum.at(far, i, d)
        limit = np.where(many >= k, far, own.column("__bound").to_numpy())
        return pa.table({key: own.column(key), "features": own.column("features"), "bound": np.minimum(limit, own.column("__bound").to_numpy())})

    def search(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        i, j, d = found(own, x, other, y)
        return pa.table({key: own.column(key).take(pa.array(i)), "near": other.column(key).take(pa.array(j)), "distance": d})

    asks = asks.select(key, "features")
    if index.whole:
        return index.join(asks, search, f"{key} {kind}, near {kind}, distance double")
    bounded = settled(index.join(asks, bounds, f"{key} {kind}, features array<double>, bound double", near=k + itself, home=True))
    met = index.join(bounded, search, f"{key} {kind}, near {kind}, distance double", bound=F.col("bound"))
    by = Window.partitionBy(key).orderBy("distance", "near")
    return met.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= k).drop("__n")


def neighbours(table: DataFrame, k: int, *, key: str = "seq_id", block: int | None = None, seen: list | None = None) -> DataFrame:
    """key, rank, near, distance: the k nearest other points, exact; the smallest key of equals.
    A join over Voronoi cells (cells.py) of the different vectors; copies get the same answer.
    seen: the index is appended, for the share of pairs compared."""
    table = table.select(key, F.transform("features", lambda v: v.cast("double")).alias("features"))
    points = settled(vectors(table, key=key))
    index = Cells(points, key=key, block=block)
    if seen is not None:
        seen.append(index)
    found = _k_nearest(index, points, k, key=key, itself=True)
    by = Window.partitionBy(key).orderBy("distance", "near")
    if not points.where("n > 1").limit(1).count():
        return found.withColumn("rank", F.row_number().over(by)).select(key, "rank", "near", "distance")
    own, first = _first_keys(table, points, k + 1, key=key)
    found = found.select(F.col(key).alias("asks"), F.col("near").alias("vector"), "distance").union(points.select(F.col(key), F.col(key), F.lit(0.0)))
    named = found.join(first, "vector").withColumn("__n", F.row_number().over(Window.partitionBy("asks").orderBy("distance", "near"))).where(F.col("__n") <= k + 1)
    out = own.join(named.select(F.col("asks").alias("vector"), "near", "distance"), "vector").where(F.col(key) != F.col("near"))
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(key, "rank", "near", "distance")


def neighbour_percentile(table: DataFrame, q: float, *, rank: int = 1, key: str = "seq_id") -> float:
    """The q quantile (linear) of the distances to the rank-th nearest other point."""
    near = neighbours(table, rank, key=key).where(F.col("rank") == rank)
    return quantile(near, "distance", q) or 0.0


def dbscan(x: np.ndarray, eps: float, least: int = 10) -> np.ndarray:
    d = distances(x) <= eps
    core, labels, n = d.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] < 0:
            todo, labels[i] = [i], n
            while todo:
                j = todo.pop()
                near = np.flatnonzero(d[j] & (labels < 0))
                labels[near] = n
                todo += [int(v) for v in near if core[v]]
            n += 1
    return labels


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y that are at most eps apart, some rows of x at a time."""
    if not len(x) or not len(y):
        return
    near = Near(x, y)
    for some, square in near.steps():
        limit, off = (eps / near.scale) ** 2 - near.size_x[some], near.off[some] + 1e-6 * (eps / near.scale) ** 2
        i, j = where(square <= np.nextafter((limit + off).astype(np.float32), np.float32(np.inf))[:, None])
        unsure = np.flatnonzero(square[i, j] >= (limit - off)[i])
        good = np.ones(len(i), bool)
        good[unsure] = squares(x, some.start + i[unsure], y, j[unsure]) <= eps * eps * (1 + 1e-15)
        yield some.start + i[good], j[good]


def _roots(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node that each of n nodes is connected with."""
    a, b = (np.concatenate([np.empty(0, np.int64), *v]) for v in zip(*edges)) if edges else (np.empty(0, np.int64),) * 2
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for v in (a, b):
            np.minimum.at(new, root[v], low)
            np.minimum.at(new, v, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def connected(edges: DataFrame, nodes: DataFrame, *, key: str) -> DataFrame:
    """key, root: the least key that each node's edges (key, near; both ways) lead to. Rounds
    of the least neighbour's root, and that root's own root, written and replaced."""
    roots = settled(nodes.select(key, F.col(key).alias("root")))
    while True:
        passed = edges.join(roots.withColumnRenamed(key, "near"), "near").groupBy(key).agg(F.min("root").alias("low"))
        new = roots.join(passed, key, "left").select(key, "root", F.least("root", F.coalesce("low", "root")).alias("low"))
        up = roots.select(F.col(key).alias("low"), F.col("root").alias("above"))
        new = settled(new.join(up, "low").select(key, F.col("above").alias("new"), "root"))
        changed = new.where(F.col("new") != F.col("root")).limit(1).count()
        roots = new.select(key, F.col("new").alias("root"))
        if not changed:
            return roots


def _counted(roots: DataFrame) -> DataFrame:
    """root, cluster: clusters count from 0 in the order of their roots."""
    return numbered(roots.select("root").distinct(), ["root"], "n").select("root", (F.col("n").cast("int") - 1).alias("cluster"))


def dbscan_blocks(table: DataFrame, eps: float, least: int = 10, *, key: str = "seq_id", block: int | None = None, seen: list | None = None) -> DataFrame:
    """key, cluster as of dbscan(). Joins over Voronoi cells (cells.py), in which points go to those rings
    only that come within eps: one counts near points, one connects core points, one looks for the core
    points near others. Points of a ring that is narrower than eps and has enough of them are core
    points without being counted. Each chunk gives the forest of its near core points, whose
    components are found by the least key; other points go to the first cluster with a core point near.
    Copies of a vector are one point with a weight. seen: the indexes are appended."""
    kind = table.select(key).schema[0].dataType.simpleString()
    table = table.select(key, F.transform("features", lambda v: v.cast("double")).alias("features"))
    points = settled(vectors(table, key=key))
    index = Cells(points, key=key, keep=("n",), block=block)

    def count(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        weight, total = other.column("n").to_numpy(), np.zeros(len(x), np.int64)
        for i, j in _within(x, y, eps):
            np.add.at(total, i, weight[j])
        return pa.table({key: own.column(key), "n": total})

    def forest(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        names = pa.concat_arrays([*own.column(key).chunks, *other.column(key).chunks])
        root = _roots(len(names), [(i, len(x) + j) for i, j in _within(x, y, eps)])
        moved = pa.array(np.flatnonzero(root != np.arange(len(root))))
        return pa.table({key: names.take(moved), "near": names.take(pa.array(root[root != np.arange(len(root))]))})

    def first(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        rank = rank_of(other.column("root"))
        order = np.argsort(rank)
        best = np.full(len(x), len(y))
        for i, j in _within(x, y, eps):
            np.minimum.at(best, i, rank[j])
        some = np.flatnonzero(best < len(y))
        return pa.table({key: own.column(key).take(pa.array(some)), "root": other.column("root").take(pa.array(order[best[some]]))})

    dense = index.dense(eps, least)
    sure = index.table.where(F.col("__ring").isin(dense)) if dense else None
    asks = index.table.where(~F.col("__ring").isin(dense)) if dense else points
    n = index.join(asks, count, f"{key} {kind}, n long", bound=eps).groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    core = n.select(key) if sure is None else n.select(key).union(sure.select(key))
    core = settled(points.join(core, key, "left_semi").select(key, "features"))
    inner = Cells(core, key=key, block=block)
    edges = inner.join(core, forest, f"{key} {kind}, near {kind}", bound=eps).where(F.col(key) != F.col("near"))
    edges = settled(edges.union(edges.select("near", key)).distinct())
    roots = connected(edges, core, key=key)
    others = points.join(core, key, "left_anti")
    outer = Cells(core.join(roots, key), key=key, keep=("root",), block=block)
    reached = outer.join(others, first, f"{key} {kind}, root {kind}", bound=eps).groupBy(key).agg(F.min("root").alias("root"))
    if seen is not None:
        seen += [index, inner, outer]
    found = settled(roots.union(reached))
    named = points.select(key, "features").join(found.join(_counted(found), "root").select(key, "cluster"), key, "left").select("features", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return table.join(named, "features").select(key, "cluster")


def _reach(x: np.ndarray, least: int) -> np.ndarray:
    """Mutual reachability: the distance, or a core distance if that is greater."""
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(least, len(x)) - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def hdbscan(x: np.ndarray, least: int = 5, smallest: int = 10) -> np.ndarray:
    """The spanning tree of mutual reachability as a hierarchy of splits; clusters are
    those that last longest, by excess of mass."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    r = _reach(x, least)
    best, source, done, edges = r[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    done[0] = True
    for _ in range(n - 1):
        b = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((float(best[b]), int(source[b]), b))
        done[b] = True
        closer = r[b] < best
        best[closer], source[closer] = r[b][closer], b

    members, root, nodes = {i: [i] for i in range(n)}, list(range(n)), {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    top = {i: None for i in range(n)}
    for k, (h, a, b) in enumerate(sorted(edges)):
        a, b = find(a), find(b)
        nodes[n + k] = (h, top[a] if top[a] is not None else a, top[b] if top[b] is not None else b, members[a] + members[b])
        root[b] = a
        members[a] = members[a] + members.pop(b)
        top[a] = n + k

    labels = np.full(n, -1)
    found: list[list[int]] = []

    def size(node: int) -> int:
        return len(nodes[node][3]) if node in nodes else 1

    def points(node: int) -> list[int]:
        return nodes[node][3] if node in nodes else [node]

    def stable(node: int, born: float) -> tuple[float, list[list[int]]]:
        mass, start = 0.0, node
        while True:
            if node not in nodes:
                return mass, [points(start)]
            h, a, b, own = nodes[node]
            lam = 1.0 / max(h, 1e-12)
            wide = [c for c in (a, b) if size(c) >= smallest]
            if len(wide) == 2:
                mass += (lam - born) * len(own)
                parts = [stable(c, lam) for c in wide]
                below = sum(p[0] for p in parts)
                return (mass, [points(start)]) if mass >= below else (below, [c for p in parts for c in p[1]])
            if not wide:
                return mass + (lam - born) * len(own), [points(start)]
            mass += (lam - born) * (len(own) - size(wide[0]))
            node = wide[0]

    node = 2 * n - 2
    h, a, b, _ = nodes[node]
    while True:
        wide = [c for c in (a, b) if size(c) >= smallest]
        if len(wide) == 2:
            found = [c for w in wide for c in stable(w, 1.0 / max(h, 1e-12))[1]]
            break
        if not wide or wide[0] not in nodes:
            break
        h, a, b, _ = nodes[wide[0]]
    for k, own in enumerate(found):
        labels[own] = k
    return labels


def optics(x: np.ndarray, least: int, *, fall: float = 0.05, smallest: int | None = None) -> np.ndarray:
    """Points in the order of reachability; clusters are the valleys between its peaks,
    which are what lies above its steepest relative step, of at least `fall`."""
    n = len(x)
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(least, n) - 1]
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        i = int(np.argmin(np.where(done, np.inf, reach))) if np.isfinite(reach[~done]).any() else int(np.flatnonzero(~done)[0])
        done[i] = True
        order.append(i)
        reach = np.where(done, reach, np.minimum(reach, np.maximum(core[i], d[i])))
    return _valleys(np.array(order, int), reach, least, fall, smallest)


def _valleys(order: np.ndarray, reach: np.ndarray, least: int, fall: float = 0.05, smallest: int | None = None) -> np.ndarray:
    """Labels of points from their order and reachability."""
    n, smallest = len(order), smallest or least
    plot = np.append(reach[order], np.inf)
    labels, k, start = np.full(n, -1), 0, 0
    finite = np.sort(plot[np.isfinite(plot)])
    step = finite[1:] / np.maximum(finite[:-1], 1e-300)
    step[: len(step) // 2] = 0  # the border is in the upper half, below the steepest step
    border = finite[int(step.argmax())] if len(step) and step.max() > 1 + fall else np.inf
    for i in range(1, n + 1):
        if plot[i] > border:
            if i - start >= smallest:
                labels[order[start:i]] = k
                k += 1
            start = i
    return labels


def _rows(table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A number from 1 (__id, in the order of the key) for each row with its key and features, and the
    different vectors (__id, features, n) under their least numbers."""
    rows = table.select(key, F.transform("features", lambda v: v.cast("double")).alias("features"))
    rows = settled(numbered(rows, [key, "features"], "__id").withColumn("__id", F.col("__id").cast("long")))
    return rows, settled(vectors(rows, key="__id"))


_LISTED = 8  # neighbours that a point lists at least for the spanning tree


def reachable_lists(points: DataFrame, least: int, total: int, *, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For points (__id, features, n): the list of each one's nearest others (__id, near, distance), least - 1 or more;
    and __id, features, core (the distance to the least-th of all rows, itself included), low (no
    point that is not listed is nearer, by mutual reachability)."""
    k = max(least - 1, _LISTED)
    lists = settled(_k_nearest(Cells(points, key="__id", block=block), points.select("__id", "features"), k, key="__id", itself=True))
    weight = lists.join(points.select(F.col("__id").alias("near"), F.col("n").alias("__w")), "near")
    told = weight.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("distance", "__w"))).alias("near"))
    start = F.struct(F.col("n").alias("n"), F.lit(0.0).cast("double").alias("core"))
    need = F.lit(min(least, total))
    reached = lambda a, x: F.struct((a["n"] + x["__w"]).alias("n"), F.when(a["n"] < need, x["distance"]).otherwise(a["core"]).alias("core"))
    core = F.when(F.col("near").isNull(), 0.0).otherwise(F.aggregate("near", start, reached)["core"])
    far = F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(F.lit(float("inf")))
    cores = points.join(told, "__id", "left").select("__id", "features", core.alias("core"), far.alias("far"))
    return lists, settled(cores.select("__id", "features", "core", F.greatest("core", "far").alias("low")))


def spanning_tree(lists: DataFrame, cores: DataFrame, *, block: int | None = None) -> DataFrame:
    """a, b, distance: the least spanning tree of mutual reachability (the distance, or a core distance if that is
    greater; of equal ones the least a, then b). By rounds each part but the greatest takes its least edge to another one. The
    lists tell it unless a point that doesn't list all of its own neighbourhood might have a lesser one; only
    such points look again, in a join over Voronoi cells bounded by the edge known."""
    heart = lambda c: cores.select(F.col("__id").alias(c), F.col("core").alias(f"core_{c}"))
    known = lists.select(F.least("__id", "near").alias("a"), F.greatest("__id", "near").alias("b"), "distance").distinct()
    known = settled(known.join(heart("a"), "a").join(heart("b"), "b").select(F.greatest("distance", "core_a", "core_b").alias("m"), "a", "b", "distance"))
    part, tree = settled(cores.select("__id", F.col("__id").alias("root"))), []
    part_of = lambda c: part.select(F.col("__id").alias(c), F.col("root").alias(f"root_{c}"))
    edge = F.struct("m", "a", "b", "distance").alias("edge")

    def search(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        """The least edge of each asking point to another part."""
        near, out, ids = Near(x, y), [], other.column("__id").to_numpy()
        mine, theirs = own.column("root").to_numpy(), other.column("root").to_numpy()
        core_x, core_y = own.column("core").to_numpy(), other.column("core").to_numpy()
        square_x, square_y = ((c / near.scale) ** 2 for c in (core_x, core_y))
        for some, square in near.steps():
            square += near.size_x[some, None].astype(np.float32)
            np.maximum(square, np.maximum(square_x[some, None], square_y[None, :]).astype(np.float32), out=square)
            square[mine[some, None] == theirs[None, :]] = np.inf
            least = square.min(axis=1).astype(float)
            limit = (least * (1 + 1e-5) + 2 * near.off[some]).astype(np.float32)
            i, j = where(square <= np.nextafter(limit, np.float32(np.inf))[:, None])
            good = np.isfinite(square[i, j])
            i, j = some.start + i[good], j[good]
            d = np.sqrt(squares(x, i, y, j))
            m = np.maximum(d, np.maximum(core_x[i], core_y[j]))
            order = np.lexsort((ids[j], m, i))
            new = order[np.diff(i[order], prepend=-1) != 0]
            out.append((i[new], j[new], d[new], m[new]))
        i, j, d, m = (np.concatenate(v) for v in zip(*out))
        return pa.table({"__id": own.column("__id").take(pa.array(i)), "near": pa.array(ids[j]), "distance": d, "m": m})

    while True:
        sizes = part.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(2).collect()
        if len(sizes) < 2:
            break
        apart = known.join(part_of("a"), "a").join(part_of("b"), "b").where("root_a <> root_b").select("root_a", "root_b", edge)
        known = settled(apart)
        best = known.select(F.explode(F.array("root_a", "root_b")).alias("root"), "edge").groupBy("root").agg(F.min("edge").alias("edge"))
        known = known.select("edge.*")
        now = settled(cores.join(part, "__id"))
        state = settled(now.groupBy("root").agg(F.min("low").alias("low")).join(best, "root", "left"))
        sure = F.coalesce(F.col("edge.m") < F.col("low"), F.lit(False))
        asks = now.join(state.where(~sure & (F.col("root") != sizes[0]["root"])).select("root", F.coalesce("edge.m", F.lit(float("inf"))).alias("bound")), "root")
        asks = settled(asks.where("low <= bound").select("__id", "features", "core", "root", "bound"))
        chosen = state.where(sure).select("root", "edge")
        if asks.limit(1).count():
            index = Cells(now.select("__id", "features", "core", "root"), key="__id", keep=("core", "root"), block=block)
            found = index.join(asks, search, "__id bigint, near bigint, distance double, m double", bound=F.col("bound"), keep=("core", "root"))
            found = found.join(part, "__id").select("root", F.struct("m", F.least("__id", "near").alias("a"), F.greatest("__id", "near").alias("b"), "distance").alias("edge"))
            again = state.join(asks.select("root").distinct(), "root", "left_semi").where("edge is not null").select("root", "edge")
            chosen = chosen.union(found.union(again).groupBy("root").agg(F.min("edge").alias("edge")))
        tree.append(settled(chosen.select("edge.*").distinct()))
        both = tree[-1].join(part_of("a"), "a").join(part_of("b"), "b")
        both = settled(both.select(F.col("root_a").alias("part"), F.col("root_b").alias("near")).union(both.select("root_b", "root_a")).distinct())
        moved = connected(both, part.select(F.col("root").alias("part")).distinct(), key="part")
        part = settled(part.join(moved.select("part", F.col("root").alias("to")), F.col("part") == F.col("root")).select("__id", F.col("to").alias("root")))
    edges = reduce(DataFrame.unionAll, tree) if tree else known
    return edges.select("a", "b", "distance")


def _walk(rep: np.ndarray, core: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of optics() and reachabilities, from points that stand for their copies (rep; copies come
    after them) and edges between these."""
    n = len(rep)
    source, target, way = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    by = np.argsort(source, kind="stable")
    start = np.searchsorted(source[by], np.arange(n + 1)).tolist()
    target, weight = target[by].tolist(), np.maximum(core[source], way)[by].tolist()
    copies: dict[int, list[int]] = {}
    for i in np.flatnonzero(rep != np.arange(n)).tolist():
        copies.setdefault(int(rep[i]), []).append(i)
    own, stands, reach, done, order = core.tolist(), rep.tolist(), [np.inf] * n, bytearray(n), []
    heap = [(np.inf, 0)] if n else []

    def told(j: int, w: float) -> None:
        if not done[j] and w < reach[j]:
            reach[j] = w
            heapq.heappush(heap, (w, j))

    while heap:
        r, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i] = 1
        order.append(i)
        if stands[i] != i:
            continue  # its edges are those of the point that stands for it
        for c in copies.get(i, ()):
            told(c, min(r, own[i]))
        for e in range(start[i], start[i + 1]):
            j, w = target[e], weight[e]
            if not done[j]:
                told(j, w)
            elif w < own[j]:
                for c in copies.get(j, ()):
                    told(c, w)
    return np.array(order, np.int64), np.array(reach)


def optics_tree(table: DataFrame, least: int, *, key: str = "seq_id", block: int | None = None) -> DataFrame:
    """key, cluster as of optics(), for any number of points. An edge along which the order goes on is one of
    the spanning tree of mutual reachability, or leads to or from one of a point's least - 1 nearest: what is less than the
    core distance of the point that is reached comes from within it. Neighbours and tree are found by joins;
    the walk over them, about a dozen numbers a point, is in its nature one thing after the other and runs in one task."""
    rows, points = _rows(table, key)
    total = rows.count()
    lists, cores = reachable_lists(points, least, total, block=block)
    tree = spanning_tree(lists, cores, block=block)
    close = lists.join(cores.select("__id", "core"), "__id").where("distance <= core")
    edges = settled(close.select(F.least("__id", "near").alias("a"), F.greatest("__id", "near").alias("b"), "distance").union(tree).distinct())
    nodes = settled(rows.join(points.select("features", F.col("__id").alias("rep")), "features").join(cores.select(F.col("__id").alias("rep"), "core"), "rep").select("__id", "rep", "core"))

    def walk(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("__id")
        ids = nodes.column("__id").to_numpy()
        at = lambda t, c: np.searchsorted(ids, t.column(c).to_numpy())
        labels = _valleys(*_walk(at(nodes, "rep"), nodes.column("core").to_numpy(), at(edges, "a"), at(edges, "b"), edges.column("distance").to_numpy()), least)
        return pa.table({"__id": nodes.column("__id"), "cluster": pa.array(labels, pa.int32())})

    one = F.lit(0).alias("__one")
    found = nodes.withColumn("__one", one).groupBy("__one").cogroup(edges.withColumn("__one", one).groupBy("__one")).applyInArrow(walk, "__id bigint, cluster int")
    return rows.select("__id", key).join(found, "__id").select(key, "cluster")


def mean_shift(x: np.ndarray, bandwidth: float, rounds: int = 100) -> np.ndarray:
    """Flat kernel; modes closer than the bandwidth are one, the fuller one first."""
    at = x.copy()
    for _ in range(rounds):
        near = distances(at, x) <= bandwidth
        new = (near @ x) / np.maximum(1, near.sum(1))[:, None]
        if np.abs(new - at).max(initial=0) < 1e-3 * bandwidth:
            break
        at = new
    full = (distances(at, x) <= bandwidth).sum(1)
    centres, n = np.empty_like(at), 0
    for i in np.argsort(-full, kind="stable"):
        if (((centres[:n] - at[i]) ** 2).sum(1) > bandwidth**2).all():
            centres[n] = at[i]
            n += 1
    return np.argmin(distances(x, centres[:n]), axis=1)


def _masks(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Which rows of y are at most eps from rows of x, some rows of x at a time."""
    near = Near(x, y)
    for some, square in near.steps():
        limit, off = (eps / near.scale) ** 2 - near.size_x[some], near.off[some] + 1e-6 * (eps / near.scale) ** 2
        good = square <= np.nextafter((limit + off).astype(np.float32), np.float32(np.inf))[:, None]
        i, j = where(good & (square >= (limit - off).astype(np.float32)[:, None]))
        good[i, j] = squares(x, some.start + i, y, j) <= eps * eps * (1 + 1e-15)
        yield some, good


def mean_shift_rounds(table: DataFrame, bandwidth: float, *, key: str = "seq_id", rounds: int = 100, block: int | None = None) -> DataFrame:
    """key, cluster as of mean_shift(), for any number of points. A round is a join of the positions over Voronoi cells of all
    points (cells.py), which gives numbers and sums of the points within the bandwidth. Components are rounded to multiples of a
    power of two that leaves sums exact (1e-9 of the greatest or less): whatever the order, the same points have the same mean, so that
    positions that meet are one from then on, and one that has come to its mean asks no more."""
    rows, points = _rows(table, key)
    size, most, total = points.agg(F.max(F.size("features")), F.max(F.array_max(F.transform("features", lambda v: F.abs(v)))), F.sum("n")).first()
    if not total:
        return table.select(key, F.lit(0).alias("cluster"))
    unit = 2.0 ** (51 - int(np.ceil(np.log2(total))) - int(np.ceil(np.log2(most or 1.0))))
    index = Cells(points, key="__id", keep=("n",), block=block)

    def add(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        weight = other.column("n").to_numpy().astype(float)[:, None]
        whole, total = np.column_stack([np.rint(y * unit) * weight, weight]), np.zeros((len(x), size + 1))
        for some, good in _masks(x, y, bandwidth):
            if 16 * np.count_nonzero(good) > good.size:
                total[some] = good.astype(float) @ whole
                continue
            i, j = where(good)
            if len(i):
                kinds, first = np.unique(i, return_index=True)
                total[some.start + kinds] = np.add.reduceat(whole[j], first, axis=0)
        met = np.flatnonzero(total[:, -1])
        return pa.table({"__id": own.column("__id").take(pa.array(met)), "total": pa.FixedSizeListArray.from_arrays(pa.array(total[met].ravel()), size + 1).cast(pa.list_(pa.float64()))})

    def shifted(at: DataFrame) -> DataFrame:
        """__id, features, new (the mean, the origin without points) and full (their number)."""
        met = index.join(at, add, "__id bigint, total array<double>", bound=bandwidth)
        sums = met.groupBy("__id").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(size + 1)]).alias("total"))
        full = F.coalesce(F.col("total")[size], F.lit(0.0))
        mean = F.transform(F.slice("total", 1, size), lambda v: v / unit / F.col("total")[size])
        return settled(at.join(sums, "__id", "left").select("__id", "features", F.coalesce(mean, F.array_repeat(F.lit(0.0), size)).alias("new"), full.cast("long").alias("full")))

    at, held, last = points.select("__id", "features"), [], None
    for _ in range(rounds):
        step = shifted(at)
        far = step.agg(F.max(F.array_max(F.zip_with("features", "new", lambda u, v: F.abs(u - v))))).first()[0]
        if far is None or far < 1e-3 * bandwidth:
            last = step.select("__id", "features", "full")
            break
        came = step.select("__id", F.col("new").alias("features"), F.when(F.col("new") == F.col("features"), F.col("full")).alias("full"))
        now = settled(reduce(DataFrame.unionByName, held, came).groupBy("features").agg(F.min("__id").alias("__id"), F.max("full").alias("full")))
        held, at = [now.where("full is not null").select("__id", "features", "full")], now.where("full is null").select("__id", "features")
    if last is None:
        last = shifted(at).select("__id", "features", "full")
    modes = reduce(DataFrame.unionByName, held, last).withColumn("__less", -F.col("full"))
    modes = settled(numbered(modes, ["__less", "__id"], "turn").select(F.col("turn").cast("long").alias("__id"), "features"))
    centres = settled(apart_in_turn(modes, bandwidth, block=block))
    names = numbered(centres.select("__id"), ["__id"], "c").select(F.col("__id").alias("rep"), (F.col("c").cast("int") - 1).alias("cluster"))
    found = nearest_representative(points.select("__id", "features"), centres, key="__id", block=block).join(names, "rep").select("__id", "cluster")
    named = points.select("__id", "features").join(found, "__id").select("features", "cluster")
    return rows.select(key, "features").join(named, "features").select(key, "cluster")


def apart_in_turn(modes: DataFrame, width: float, *, block: int | None = None) -> DataFrame:
    """Of modes (__id, features) those that are farther than width from all chosen before, in the order of __id.
    In a round those without an earlier one within width are chosen and all near them go; what fits one chunk is done in one place."""
    chosen, left = [], modes

    def beaten(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        mine, theirs, lost = own.column("__id").to_numpy(), other.column("__id").to_numpy(), np.zeros(len(x), bool)
        for i, j in _within(x, y, width):
            lost[i[theirs[j] < mine[i]]] = True
        return pa.table({"__id": pa.array(mine[lost])})

    def near(own: pa.Table, x: np.ndarray, other: pa.Table, y: np.ndarray) -> pa.Table:
        hit = np.zeros(len(x), bool)
        for i, _ in _within(x, y, width):
            hit[i] = True
        return pa.table({"__id": pa.array(own.column("__id").to_numpy()[hit])})

    while left.count() > (block or BLOCK):
        lost = Cells(left, key="__id", block=block).join(left, beaten, "__id bigint", bound=width).distinct()
        chosen.append(settled(left.join(lost, "__id", "left_anti")))
        gone = Cells(chosen[-1], key="__id", block=block).join(left, near, "__id bigint", bound=width).distinct()
        left = settled(left.join(gone, "__id", "left_anti"))
    rest = left.orderBy("__id").toArrow()  # BLOCK rows at most
    x, ids, keep = matrix(rest.column("features")), rest.column("__id").to_pylist(), []
    for i in range(len(ids)):
        if not keep or (((x[keep] - x[i]) ** 2).sum(1) > width**2 * (1 + 1e-15)).all():
            keep.append(i)
    rest = modes.sparkSession.createDataFrame([(ids[i], x[i].tolist()) for i in keep], "__id long, features array<double>")
    return reduce(DataFrame.unionByName, chosen, rest)


def affinity_propagation(x: np.ndarray, preference: float, *, damping: float = 0.5, rounds: int = 200) -> np.ndarray:
    n = len(x)
    s = -(distances(x) ** 2)
    np.fill_diagonal(s, preference)
    s += 1e-12 * np.abs(s).max() * np.random.default_rng(0).standard_normal((n, n))
    r, a, rows = np.zeros((n, n)), np.zeros((n, n)), np.arange(n)
    for _ in range(rounds):
        t = a + s
        first = t.argmax(1)
        top = t[rows, first]
        t[rows, first] = -np.inf
        new = s - top[:, None]
        new[rows, first] = s[rows, first] - t.max(1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(0)[None, :] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    centres = np.flatnonzero((a + r).diagonal() > 0)
    if not len(centres):
        return np.full(n, -1)
    labels = s[:, centres].argmax(1)
    labels[centres] = np.arange(len(centres))
    return labels


_FED = 20_000  # points of a first tree, about
_FAN = 8  # trees whose features meet in one


def clustering_features(table: DataFrame, threshold: float, *, key: str = "seq_id", most: int = MOST_FEATURES, fed: int = _FED) -> DataFrame:
    """n, mean array<double>, s (sum of squared deviations), threshold: at most `most` features of all
    points, each of a radius of at most the greatest threshold given. A tree (features.py) to a share of the
    points by hash; rounds then feed the features of eight trees to one, until there is one.
    No task has more than a share's points, or eight trees' features."""
    schema = "part int, n double, mean array<double>, s double, threshold double"
    n = table.count()
    parts = max(1, -(-n // fed))
    share = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(parts)).cast("int")
    rows = table.select(share.alias("part"), F.lit(1.0).alias("n"), F.transform("features", lambda v: v.cast("double")).alias("mean"), F.lit(0.0).alias("s"), F.lit(float(threshold)).alias("threshold"), F.xxhash64(key).alias("turn"))

    def grow(group: pa.Table) -> pa.Table:
        x = matrix(group.column("mean"))
        weight, s, turn = (group.column(c).to_numpy() for c in ("n", "s", "turn"))
        tree = Tree(x.shape[1], float(group.column("threshold").to_numpy().max()), most)
        for i in np.lexsort((*x.T[::-1], turn)).tolist():
            tree.add(float(weight[i]), x[i], float(s[i]))
        n, mean, s = tree.leaves()
        return pa.table({"part": pa.array(np.full(len(n), group.column("part")[0].as_py() // _FAN, np.int32)), "n": n, "mean": pa.array(mean.tolist(), pa.list_(pa.float64())), "s": s, "threshold": np.full(len(n), tree.threshold)})

    while True:
        found = settled(rows.groupBy("part").applyInArrow(grow, schema))
        if parts == 1:
            return found.drop("part")
        parts = -(-parts // _FAN)
        rows = found.withColumn("turn", F.lit(0).cast("long"))


def birch(table: DataFrame, k: int, threshold: float, *, key: str = "seq_id", most: int = MOST_FEATURES, fed: int = _FED) -> DataFrame:
    """key, cluster: Ward over the means of the clustering features, with their numbers, into k;
    each point has the label of the nearest mean. The features are a bounded number of rows."""
    kept = clustering_features(table, threshold, key=key, most=most, fed=fed).orderBy("mean").toArrow()
    means = matrix(kept.column("mean"))
    if not len(means):
        return table.select(key, F.lit(0).alias("cluster"))
    labels = ward(means, k, kept.column("n").to_numpy())
    kind = table.select(key).schema[0].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels[between(matrix(part.column(1)), means).argmin(1)], pa.int32())], names=[key, "cluster"])

    return table.select(key, F.transform("features", lambda v: v.cast("double")).alias("features")).mapInArrow(label, f"`{key}` {kind}, cluster int")


def spectral(table: DataFrame, k: int, *, near: int = 10, key: str = "seq_id") -> DataFrame:
    """Power iteration on the graph of nearest neighbours; a relative of spectral clustering."""
    names = settled(numbered(table.select(key).distinct(), [key], "n").select((F.col("n").cast("long") - 1).alias("n"), key))
    edges = neighbours(table, near, key=key).join(names.withColumnRenamed("n", "src"), key)
    edges = edges.join(names.select(F.col("n").alias("dst"), F.col(key).alias("near")), "near")
    pair = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1.0).alias("weight")).distinct()
    got = PowerIterationClustering(k=k, maxIter=30, weightCol="weight", srcCol="src", dstCol="dst").assignClusters(pair)
    return got.join(names, got.id == names.n).select(key, F.col("cluster").cast("int").alias("cluster"))


def _estimated(method: str, table: DataFrame, x: np.ndarray, k: int, key: str) -> np.ndarray:
    p = lambda q, rank=1: neighbour_percentile(table, q, rank=rank, key=key)
    if method == "hdbscan":
        return hdbscan(x, max(int(p(0.9)), 1), 10)
    if method == "affinity":
        return affinity_propagation(x, -10 * p(0.5))
    return ward(x, k)


METHODS = ("kmeans", "hierarchical", "dbscan", "hdbscan", "birch", "optics", "gmm", "meanshift", "affinity", "spectral")


def cluster(table: DataFrame, method: str, k: int = 10, *, key: str = "seq_id", seed: int = 42) -> DataFrame:
    """key, cluster by a named method; its other parameters are estimated from the data."""
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(METHODS)}")
    if method == "kmeans":
        return kmeans(table, k, key=key, seed=seed)[0]
    if method == "gmm":
        return mixture(table, None, key=key, seed=seed)
    if method == "hierarchical":
        return ward_tiered(table, k, key=key, seed=seed)
    if method == "dbscan":
        return dbscan_blocks(table, neighbour_percentile(table, 0.9, key=key), 10, key=key)
    if method == "birch":
        return birch(table, k, neighbour_percentile(table, 0.75, key=key), key=key)
    if method == "spectral":
        return spectral(table, k, key=key)
    if method == "optics":
        return optics_tree(table, max(2, int(neighbour_percentile(table, 0.9, key=key))), key=key)
    if method == "meanshift":
        return mean_shift_rounds(table, neighbour_percentile(table, 0.5, rank=4, key=key), key=key)
    if table.count() > MOST:
        reps = settled(reduced(table.select(key, "features"), MOST, key=key, seed=seed))
        return propagated(table, reps.join(cluster(reps, method, k, key=key, seed=seed), key), key=key)
    ids, x = points_of(table, key=key)
    return _labelled(table, ids, _estimated(method, table, x, k, key), key)


def reduced(table: DataFrame, n: int, strategy: str = "kmeans", *, key: str = "seq_id", seed: int = 42) -> DataFrame:
    """Representatives: the member nearest to each k-means centre (empty clusters are
    skipped), rows chosen by hash, or all."""
    if strategy == "none":
        return table
    if strategy == "random":
        return sample_of(table, n, key=key, seed=seed)
    if strategy != "kmeans":
        raise ValueError(f"no reduction {strategy!r}")
    if table.count() <= n:
        return table
    rows = settled(table.select(key, F.transform("features", lambda v: v.cast("double")).alias("features")))
    members = placed(rows, centres_of(rows, n, key=key, seed=seed), key=key)
    best = members.groupBy("place").agg(F.min_by(key, F.struct("away", key)).alias(key))
    return table.join(best.select(key), key, "left_semi")


def nearest_representative(table: DataFrame, reps: DataFrame, *, key: str = "seq_id", block: int | None = None) -> DataFrame:
    """key, rep, distance: the nearest row of reps, the smallest key of equals, for any number of
    them: a join over Voronoi cells of reps (cells.py). Of copies in reps the smallest key stands for all."""
    wide = lambda df: df.select(key, F.transform("features", lambda v: v.cast("double")).alias("features"))
    index = Cells(settled(vectors(wide(reps), key=key)), key=key, block=block)
    return _k_nearest(index, wide(table), 1, key=key, itself=False).select(key, F.col("near").alias("rep"), "distance")


def propagated(table: DataFrame, labelled: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """key, cluster of every point from labelled representatives (key, features, cluster)."""
    near = nearest_representative(table, labelled, key=key)
    return near.join(labelled.select(F.col(key).alias("rep"), "cluster"), "rep").select(key, "cluster")


def centroids(table: DataFrame, *, size: int | None = None) -> DataFrame:
    """cluster, centre array<double>, n; noise left out."""
    head = None if size else table.select(F.size("features")).first()
    n = size or (head[0] if head else 0)
    rows = table.where("cluster >= 0")
    return rows.groupBy("cluster").agg(F.array(*[F.avg(F.col("features")[i].cast("double")) for i in range(n)]).cast("array<double>").alias("centre"), F.count("*").alias("n"))


def to_centroid(table: DataFrame) -> DataFrame:
    """The table with the distance to its cluster's centre."""
    return table.join(centroids(table), "cluster").withColumn("distance", distance("features", "centre"))


def diversity(table: DataFrame) -> DataFrame:
    """cluster, diversity: mean over greatest distance to the centre; 0 for a single point."""
    d = to_centroid(table).groupBy("cluster").agg(F.avg("distance").alias("a"), F.max("distance").alias("m"), F.count("*").alias("n"))
    return d.select("cluster", F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(F.try_divide("a", "m"), F.lit(0.0))).alias("diversity"))


def nearest_to_centroid(table: DataFrame, *, key: str = "seq_id") -> DataFrame:
    return to_centroid(table).groupBy("cluster").agg(F.min_by(key, F.struct("distance", key)).alias(key))


def farthest_points(x: np.ndarray, n: int) -> list[int]:
    """Indices, sorted: the point nearest to the mean first, then always the one farthest
    from those chosen; the lowest index of equals."""
    if len(x) <= n:
        return list(range(len(x)))
    chosen = [int(np.linalg.norm(x - x.mean(0), axis=1).argmin())]
    gap = np.linalg.norm(x - x[chosen[0]], axis=1)
    gap[chosen] = -1
    while len(chosen) < n:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
        gap[chosen] = -1
    return sorted(chosen)


def compress(table: DataFrame, target: int = 100, *, key: str = "seq_id", spread: float = 0.3, share: float = 0.1) -> DataFrame:
    """Representatives of labelled points: all, if there are no more than target; else of
    each cluster the point nearest to the centre, or in diverse ones (over `spread`) a
    tenth of it chosen by farthest points. Clusters of more than MOST points are dealt by a hash of
    the key into parts of about as many at most, each of which gives a tenth of its own."""
    if table.count() <= target:
        return table.select(key, "cluster")
    size = table.groupBy("cluster").agg(F.ceil(F.count("*") / float(MOST)).alias("parts"))
    wide = diversity(table).where(F.col("diversity") > spread).join(size, "cluster").select("cluster", "parts")
    near = nearest_to_centroid(table.join(wide, "cluster", "left_anti"), key=key).select(key, "cluster")
    kind = table.select(key).schema[0].dataType.simpleString()

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        at = farthest_points(np.array(group["features"].tolist(), float), max(1, int(len(group) * share)))
        return group.iloc[at][[key, "cluster"]]

    chosen = table.where("cluster >= 0").join(wide, "cluster").select(key, "cluster", "features", F.pmod(F.xxhash64(key), "parts").alias("part"))
    return near.unionByName(chosen.groupBy("cluster", "part").applyInPandas(pick, f"{key} {kind}, cluster int"))


def compress_reads(features: DataFrame, target: int = 100, *, key: str = "seq_id") -> DataFrame:
    """key, cluster, n_reads of one read to a cluster: features (as of stats.features) are
    standardized, clustered by Ward into at most `target`, and of each cluster the read nearest to
    the centre stands for n_reads. Up to target reads each is its own cluster."""
    names = [c for c in features.columns if c != key]
    table = settled(standardized(features, names).select(key, F.array(*names).alias("features")))
    if table.count() <= target:
        return numbered(table.select(key), [key], "n").select(key, (F.col("n").cast("int") - 1).alias("cluster"), F.lit(1).cast("long").alias("n_reads"))
    labelled = table.join(ward_tiered(table, target, key=key), key)
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n_reads"))
    return nearest_to_centroid(labelled, key=key).join(sizes, "cluster").select(key, "cluster", "n_reads")


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by one matrix product; those of near points, where rounding tells, by their differences."""
    size_x, size_y = (x * x).sum(1), (y * y).sum(1)
    square = np.column_stack([x, size_x, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), size_y]).T
    i, j = np.nonzero(square <= 1e-5 * (size_x.max(initial=0) + size_y.max(initial=0)))
    for at in range(0, len(i), 1 << 15):
        some = slice(at, at + (1 << 15))
        square[i[some], j[some]] = ((x[i[some]] - y[j[some]]) ** 2).sum(1)
    return np.sqrt(square, out=square)


def silhouettes(table: DataFrame, *, key: str = "seq_id", block: int | None = None) -> DataFrame:
    """key, cluster, silhouette with Euclidean distances, exact; 0 in clusters of one;
    noise left out."""
    kind = table.select(key).schema[0].dataType.simpleString()

    def run(own: pd.DataFrame, x: np.ndarray, other: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        kinds, at = np.unique(other["cluster"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        first, y = np.searchsorted(at[order], np.arange(len(kinds))), y[order]
        total = np.concatenate([np.add.reduceat(_exact(x[i : i + 128], y), first, axis=1) for i in range(0, len(x), 128)])
        n = np.bincount(at, minlength=len(kinds))
        wide, many = len(kinds), len(own)
        return pd.DataFrame({key: np.repeat(own[key].to_numpy(), wide), "cluster": np.repeat(own["cluster"].to_numpy(), wide), "other": np.tile(kinds, many), "total": total.ravel(), "n": np.tile(n, many)})

    rows = table.where("cluster >= 0").select(key, "features", F.col("cluster").cast("int").alias("cluster"))
    block = block or min(_WIDE, max(BLOCK, -(-rows.count() // 16)))  # a row goes to sixteen groups, to more only beyond 16 * _WIDE rows
    sums = _met(rows, run, f"{key} {kind}, cluster int, other int, total double, n long", key=key, keep=("cluster",), block=block)
    sums = sums.groupBy(key, "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("other") == F.col("cluster")
    near = sums.groupBy(key, "cluster").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("total") / F.greatest(F.lit(1), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return near.select(key, "cluster", s.alias("silhouette"))


def silhouette_by_cluster(table: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """cluster, silhouette: the mean over its members."""
    return silhouettes(table, key=key).groupBy("cluster").agg(F.avg("silhouette").alias("silhouette"))


def silhouette(table: DataFrame, *, key: str = "seq_id") -> float:
    return float(silhouettes(table, key=key).agg(F.avg("silhouette")).first()[0] or 0.0)


def compared(table: DataFrame, methods: list[str], k: int, *, key: str = "seq_id", score: Callable = silhouette) -> list[dict]:
    """For each method: clusters, score, seconds, or what went wrong."""
    out = []
    for method in methods:
        began = time.perf_counter()
        try:
            labels = settled(cluster(table, method, k, key=key))
            n = labels.where("cluster >= 0").select("cluster").distinct().count()
            out.append({"method": method, "clusters": n, "score": score(table.join(labels, key), key=key) if n > 1 else 0.0, "seconds": time.perf_counter() - began})
        except Exception as e:  # noqa: BLE001  the grid goes on; the row says what happened
            out.append({"method": method, "error": str(e)[:200], "seconds": time.perf_counter() - began})
    return out


def pipeline(table: DataFrame, k: int, *, reduce_to: int = 5_000, strategy: str = "kmeans", key: str = "seq_id", seed: int = 42) -> DataFrame:
    """Reduce, cluster the representatives by Ward, label every point by the nearest one."""
    reps = settled(reduced(table, reduce_to, strategy, key=key, seed=seed))
    labels = ward_tiered(reps, k, key=key, seed=seed)
    return propagated(table, reps.join(labels, key), key=key)


def ranked_by_distance(table: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """Members of each cluster by distance to the centre."""
    by = Window.partitionBy("cluster").orderBy("distance", key)
    return to_centroid(table).withColumn("rank", F.row_number().over(by)).select("cluster", key, "distance", "rank")
