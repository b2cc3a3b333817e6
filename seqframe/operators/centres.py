"""k-means with thousands of centres, for reductions.

Spark ML's k-means seeds such numbers in one thread of the driver for minutes and compares vector by vector;
here all comparisons are matrix products inside tasks (cells.nearest, exact). The method is the same: k-means||
(two steps of about 2k points each, as likely as their squared distance from those chosen), weighted k-means++ over
these, then rounds of means until no centre moves by more than TOLERANCE. What is chosen follows hashes of
the keys, so that it doesn't depend on how rows are dealt. The driver has the candidates, about 4k of them,
and the centres; tasks give it a sum to a centre, added up by shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.operators.cells import matrix, nearest
from seqframe.scratch import settled

STEPS = 2
TOLERANCE = 1e-4
_SHARES = 16  # of the centres, whose sums are added up apart


def placed(rows: DataFrame, marks: np.ndarray, *, key: str, first: int = 0) -> DataFrame:
    """Rows (key, features, and place and away if they have been placed) with the nearest mark, counted from
    `first`, and its distance, where that is less than before. Of equals the lowest mark."""
    kind = rows.select(key).schema[0].dataType.simpleString()
    if "place" not in rows.columns:
        rows = rows.withColumns({"place": F.lit(-1), "away": F.lit(float("inf"))})
    sent = rows.sparkSession.sparkContext.broadcast(marks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, away = batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
            i, j, d = nearest(matrix(batch.column(1)), sent.value, np.arange(len(sent.value)), 1)
            less = d < away[i]
            at[i[less]], away[i[less]] = first + j[less], d[less]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(away)], names=[key, "features", "place", "away"])

    return rows.select(key, "features", "place", "away").mapInArrow(place, f"`{key}` {kind}, features array<double>, place int, away double")


def _added(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of x by their places, of which there are n."""
    order = np.argsort(at, kind="stable")
    kinds, starts = np.unique(at[order], return_index=True)
    total = np.zeros((n, x.shape[1]))
    if len(kinds):
        total[kinds] = np.add.reduceat(x[order], starts, axis=0)
    return total


def _seeds(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 30) -> np.ndarray:
    """k-means++ and rounds of means over weighted points."""
    rng, middle = np.random.default_rng(seed), x.mean(0)
    x = x - middle
    size, least, chosen = (x * x).sum(1), np.ones(len(x)), []
    for _ in range(k):
        up = np.cumsum(least * weight)
        if not up[-1] > 0:
            break
        i = min(int(np.searchsorted(up, rng.random() * up[-1], side="right")), len(x) - 1)
        square = np.maximum(size + size[i] - 2 * (x @ x[i]), 0)
        least = np.minimum(least, square) if chosen else square
        least[i] = 0
        chosen.append(i)
    y, at = x[chosen], None
    for _ in range(rounds):
        new = nearest(x, y, np.arange(len(y)), 1)[1]
        if at is not None and np.array_equal(new, at):
            break
        at = new
        n = np.bincount(at, weight, len(y))
        y = np.where(n[:, None] > 0, _added(x * weight[:, None], at, len(y)) / np.maximum(n, 1)[:, None], y)
    return y + middle


def seeds(rows: DataFrame, k: int, *, key: str, seed: int = 42) -> np.ndarray:
    """At most k starting centres by k-means||."""
    one = rows.select("features").orderBy(F.xxhash64(key, F.lit(seed)), key).limit(1).toArrow()
    marks = new = matrix(one.column("features"))
    for step in range(STEPS):
        rows = settled(placed(rows, new, key=key, first=len(marks) - len(new)))
        total = rows.agg(F.sum(F.col("away") ** 2)).first()[0] or 0.0
        draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(step)), 11) / float(1 << 53)
        some = rows.where(draw * total < 2.0 * k * F.col("away") ** 2).select(key, "features").orderBy(key).toArrow()  # about 2k rows
        if not some.num_rows:
            return marks
        new = matrix(some.column("features"))
        marks = np.concatenate([marks, new])
    weight = np.zeros(len(marks))
    for r in placed(rows, new, key=key, first=len(marks) - len(new)).groupBy("place").count().collect():  # a row to a candidate
        weight[r["place"]] = r["count"]
    marks, weight = marks[weight > 0], weight[weight > 0]  # copies have none
    return marks if len(marks) <= k else _seeds(marks, weight, k, seed)


def means(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean of the rows nearest to each centre; without any it stays."""
    k, size = centres.shape
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    borders = [int(b) for b in np.linspace(0, k, min(k, _SHARES) + 1)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, size))
        for batch in batches:
            x = matrix(batch.column(0))
            i, j, _ = nearest(x, sent.value, np.arange(k), 1)
            n += np.bincount(j, minlength=k)
            total += _added(x[i], j, k)
        part = TaskContext.get().partitionId()
        for share, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([part], pa.int32()), pa.array([n[a:b]]), pa.array([total[a:b].ravel()])], names=["share", "part", "n", "total"])

    def added(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")  # the same sums whichever task ends first
        n, total = matrix(group.column("n")).sum(0).astype(np.int64), matrix(group.column("total")).sum(0)
        return pa.table({"share": group.column("share").slice(0, 1), "n": pa.array([n]), "total": pa.array([total])})

    parts = rows.select("features").mapInArrow(add, "share int, part int, n array<long>, total array<double>")
    shares = parts.groupBy("share").applyInArrow(added, "share int, n array<long>, total array<double>").collect()  # a sum to a centre
    shares.sort(key=lambda r: r["share"])
    n = np.concatenate([r["n"] for r in shares])
    total = np.concatenate([r["total"] for r in shares]).reshape(k, size)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)


def centres_of(rows: DataFrame, k: int, *, key: str, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """At most k centres of rows (key, features array<double>)."""
    centres = seeds(rows, k, key=key, seed=seed)
    for _ in range(rounds):
        new = means(rows, centres)
        moved = ((new - centres) ** 2).sum(1).max(initial=0)
        centres = new
        if moved <= TOLERANCE**2:
            break
    return centres
