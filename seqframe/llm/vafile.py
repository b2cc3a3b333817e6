"""Exact top-k inner products by a vector-approximation file.

The file has one byte a component: the cell between equally spaced marks of the
dimension's range, which one aggregation over all vectors finds. It is written once. A
query bounds its product with any candidate from both sides by the candidate's cells.

1. Scan: blocks of queries meet blocks of cells. Of a block a query keeps what may still
   reach its k best: all candidates whose upper bound is not below the k-th lower bound
   (of equal vectors those with the k smallest ids: the others score the same and come later).
2. The k-th lower bound over all blocks thins these out.
3. Exact vectors are read in the order of upper bounds: first those of the leading
   candidates, then those whose upper bound still reaches the k-th exact score. What
   is left can't change the result, ties included, so it is certain then.

Only cells are replicated to the query blocks; exact vectors are read for survivors,
in joins by id. Neither side goes through the driver or is broadcast by a hint; a stated query
set against all rows has the cost of step 1 by its nature.

Vectors that are null, or hold null or non-finite components, or none at all, take no part,
and only vectors of the same length meet. Components become floor(scale * x) as whole numbers;
sums are exact (one beyond a long becomes the nearest long). Bounds are doubles, widened by
more than their rounding. A vector never meets rows with its own id, repeated rows included; a
repeated candidate row counts once. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seqframe.llm.common import cut

CANDIDATES, QUERIES = 16_384, 4_096  # rows of a block, about
LEADING = 4  # times k: candidates that are read first
_AT_ONCE = 256  # queries whose bounds are held at a time
_SLACK = 2.0**-46  # of the sum of absolute products


def quantised(table: DataFrame, *, key: str, vector: str, scale: int) -> DataFrame:
    """Columns: id, h (hash of v), v array<long>, dim."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(F.col(vector), lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0))
    return rows.select(F.col(key).alias("id"), v.alias("v")).select("id", F.xxhash64("v").alias("h"), "v", F.size("v").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            x = _matrix(batch.column(1).filter(pa.array(dims == dim)), dim)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), x.min(axis=0), x.max(axis=0))], names=["dim", "k", "lo", "hi"])


def marks(rows: DataFrame, bits: int) -> DataFrame:
    """Columns: dim, lo, width array<double>: of each dimension where the first cell begins and
    how wide a cell is; one row to a length of vectors."""
    every = rows.select("dim", "v").mapInArrow(_ranges, "dim int, k int, lo long, hi long").groupBy("dim", "k").agg(F.min("lo").cast("double").alias("lo"), F.max("hi").cast("double").alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / float(1 << bits)).cast("double"), F.lit(1.0))
    sorted_ = every.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("k", "lo", width.alias("width")))).alias("m"))
    return sorted_.select("dim", F.col("m.lo").alias("lo"), F.col("m.width").alias("width"))


def cells(x: np.ndarray, lo: np.ndarray, width: np.ndarray, bits: int) -> np.ndarray:
    """uint8: lo + width * c <= x <= lo + width * (c + 1), but for rounding."""
    return np.clip((x - lo) // width, 0, (1 << bits) - 1).astype(np.uint8)


def bounds(q: np.ndarray, cell: np.ndarray, lo: np.ndarray, width: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products, queries by candidates."""
    far = np.maximum(np.abs(lo), np.abs(lo + width * (1 << bits)))
    slack = (np.abs(q) @ far * _SLACK)[:, None]
    base = (q * width) @ cell.astype(np.float64).T + (q @ lo)[:, None]
    return base + (np.minimum(q, 0) @ width)[:, None] - slack, base + (np.maximum(q, 0) @ width)[:, None] + slack


def approximated(rows: DataFrame, marked: DataFrame, bits: int) -> DataFrame:
    """The vector-approximation file: id, h, dim, cells binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x, lo, width = (_matrix(part.column(i), dim).astype(np.float64) for i in (3, 4, 5))
                made = cells(x, lo, width, bits).tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([made[i : i + dim] for i in range(0, len(made), dim)], pa.binary())], names=["id", "h", "dim", "cells"])

    return rows.join(marked, "dim").select("id", "h", "dim", "v", "lo", "width").mapInArrow(run, "id long, h long, dim int, cells binary")


_NEAR = pa.schema([("query_id", pa.int64()), ("qh", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("low", pa.float64()), ("up", pa.float64())])
_NEAR_SQL = "query_id long, qh long, id long, h long, low double, up double"


def _scan(k: int, bits: int):
    """A block of queries against a block of cells."""

    def run(t: pa.Table) -> pa.Table:
        asks = t["v"].is_valid().to_numpy()
        asking, rows = t.filter(pa.array(asks)).combine_chunks(), t.filter(pa.array(~asks)).combine_chunks()
        if not asking.num_rows or not rows.num_rows:
            return _NEAR.empty_table()
        dim = asking["dim"][0].as_py()
        qid, qh, xid, xh = (x.to_numpy() for x in (asking["id"], asking["h"], rows["id"], rows["h"]))
        # Repeated rows are in the same block. Of equal vectors only the k smallest ids, and the query's own, can matter.
        new = np.unique(np.stack([xh, xid]), axis=1, return_index=True)[1]
        first = np.flatnonzero(np.diff(xh[new], prepend=xh[new[0]] - 1) != 0)
        nth = np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))
        new = new[nth <= k]
        xid, xh = xid[new], xh[new]
        cell = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.uint8).reshape(-1, dim)[new]
        q = _matrix(asking["v"].combine_chunks(), dim).astype(np.float64)
        lo, width = (np.array(asking[c][0].as_py()) for c in ("lo", "width"))
        out = []
        for a in range(0, len(q), _AT_ONCE):
            low, up = (np.clip(b, -(2.0**63), 2.0**63) for b in bounds(q[a : a + _AT_ONCE], cell, lo, width, bits))  # as scores end there
            for r in range(len(low)):
                other = xid != qid[a + r]
                own = low[r, other]
                least = np.partition(own, -k)[-k] if len(own) >= k else -np.inf
                near = np.flatnonzero(other & (up[r] >= least))
                n = len(near)
                out.append((np.full(n, qid[a + r]), np.full(n, qh[a + r]), xid[near], xh[near], low[r, near], up[r, near]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_NEAR)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, qh, id, h and the score of v and qv."""
    top, least = (1 << 63) - 1, -(1 << 63)
    for part in batches:
        scores = []
        for v, q in zip(part.column(4), part.column(5), strict=True):
            x, y = v.values.to_numpy(), q.values.to_numpy()
            size = float(np.abs(x.astype(np.float64)) @ np.abs(y.astype(np.float64)))
            scores.append(int(x @ y) if size < 2.0**62 else max(least, min(top, sum(a * b for a, b in zip(x.tolist(), y.tolist(), strict=True)))))
        yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(scores, pa.int64())], names=["query_id", "qh", "id", "h", "score"])


def top_k(table: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, bits: int = 6, fit_rows: tuple[int, int] = (CANDIDATES, QUERIES)) -> DataFrame:
    """Columns: query_id long, rank int (from 1), key long, score long. queries: the
    condition that rows which ask fulfil. Ties go to the smaller id. bits: of a cell, 8 at most."""
    rows = quantised(table, key=key, vector=vector, scale=scale)
    marked, _ = cut(marks(rows, bits))
    file, _ = cut(approximated(rows, marked, bits))
    asking = quantised(table.where(queries), key=key, vector=vector, scale=scale).distinct()
    n, m = file.count(), asking.count()
    blocks, groups = max(1, -(-n // fit_rows[0])), max(1, -(-m // fit_rows[1]))
    share = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    left = file.select("dim", share(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "id", "h", "cells", none("array<long>").alias("v"), none("array<double>").alias("lo"), none("array<double>").alias("width"))
    right = asking.join(marked, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), share(groups, 2).alias("part"), "id", "h", none("binary").alias("cells"), "v", "lo", "width")
    near = left.union(right).groupBy("dim", "block", "part").applyInArrow(_scan(k, bits), _NEAR_SQL)
    own = Window.partitionBy("query_id")
    nth = lambda by: F.row_number().over(own.orderBy(F.desc(by), "id", "h", "qh"))
    near = near.withColumn("r", nth("low")).withColumn("floor", F.max(F.when(F.col("r") == k, F.col("low"))).over(own))
    near = near.where("floor is null or up >= floor").withColumn("r", nth("up")).select("query_id", "qh", "id", "h", "up", "r")
    near, _ = cut(near)
    vectors = rows.select("id", "h", "v")
    ask = asking.select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("qv"))

    def scored(some: DataFrame) -> DataFrame:
        met = some.join(vectors, ["id", "h"]).join(ask, ["query_id", "qh"]).select("query_id", "qh", "id", "h", "v", "qv")
        found = met.mapInArrow(_exact, "query_id long, qh long, id long, h long, score long")
        return found.groupBy("query_id", "qh", "id", "h").agg(F.first("score").alias("score"))

    first, _ = cut(scored(near.where(F.col("r") <= LEADING * k)))
    best = lambda t: t.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "id", "h", "qh")))
    sure = best(first).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    rest = near.where(F.col("r") > LEADING * k).join(sure, "query_id").where("up >= reached")
    return best(first.union(scored(rest))).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
