"""Metric joins over Voronoi cells.

The points that are searched belong to the cell of their nearest pivot, and within a cell to
a ring of distances from it. What the driver knows of them is a row to a ring: at most
MOST_CELLS times RINGS rows, however many points there are. An asking point with a bound on
the distances it cares for goes to the rings that the triangle inequality and the border
between two cells don't rule out, and to no others. Rings with many points are dealt into
chunks of about BLOCK by a hash, and so are the points that ask them, so that no group of the
join grows with the data. Copies of a vector are one point to the callers here.

Vectors without structure in many dimensions go to nearly all rings, and sending them there costs more
than the rings save. A join reckons both ways from a bounded number of asking points; if wide
blocks of all rows with each other cost less, they meet instead (meeting()): more pairs, the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.scratch import settled

BLOCK = 2_048  # rows of a chunk, about
ASKING = 8_192  # rows that ask a chunk together, about
MOST_CELLS = 1_024
RINGS = 16  # of a cell at most
_RING = 128  # points of a ring at least, about
WIDE = 65_536  # rows of a block at most, about, where all rows meet
FOLD = 12  # blocks of a side, more only beyond FOLD * WIDE rows
_TRIED = 1_024  # asking points that a join is reckoned from
_ROW = 250  # pairs that cost as much as sending a row
_STEP = 1 << 22  # pairs in memory at once, about


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1 if len(column) else 0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def _deal(key: str, salt: str, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _blocks(n: int, block: int) -> int:
    """Blocks of a side of n rows: of `block` rows, but FOLD unless they get too wide, so that what a row is sent to doesn't grow."""
    return max(1, min(FOLD, -(-n // block)), -(-n // WIDE))


def meeting(asks: DataFrame, others: DataFrame, n_asks: int, n_others: int, run: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.Table], schema: str, *, key: str, block: int | None = None) -> DataFrame:
    """What run returns for each block of asking rows with each block of other rows; both tables have the key and features."""
    parts, chunks = _blocks(n_asks, block or BLOCK), _blocks(n_others, block or BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asks.toDF(*asks.columns)  # other columns than those of the same table in others
    left = asks.select("*", _deal(key, "asks", parts).alias("__part")).select("*", every(chunks).alias("__chunk"))
    right = others.select("*", _deal(key, "index", chunks).alias("__chunk")).select("*", every(parts).alias("__part"))
    return _grouped(left, right, ["__chunk", "__part"], run, schema)


def _grouped(left: DataFrame, right: DataFrame, by: list[str], run: Callable, schema: str) -> DataFrame:
    empty = _empty(schema)

    def meet(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows or not other.num_rows:
            return empty
        return run(own, matrix(own.column("features")), other, matrix(other.column("features")))

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


class Bounds:
    """What tasks get of the cells: pivots, and of each ring its cell, least and greatest
    distance to the pivot and number of points."""

    def __init__(self, pivots: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray):
        order = np.lexsort((low, cell))
        self.pivots, self.cell, self.low, self.high, self.n = pivots, cell[order], low[order], high[order], n[order]
        self.order = order
        self.kinds, self.first = np.unique(self.cell, return_index=True)
        self.cell_low, self.cell_high = np.minimum.reduceat(self.low, self.first), np.maximum.reduceat(self.high, self.first)
        self.cell_n = np.add.reduceat(self.n, self.first)
        self.apart = distances(pivots, pivots)
        #: Above the rounding of distances from pivots.
        self.slack = 1e-6 * float(max(np.abs(self.high).max(initial=0), self.apart.max(initial=0))) + 1e-12

    def nearest_cell(self, d: np.ndarray) -> np.ndarray:
        """The nearest cell with points, for distances to all pivots."""
        return self.kinds[d[:, self.kinds].argmin(1)]

    def least(self, d: np.ndarray) -> np.ndarray:
        """The distance that points of each cell with points have at least, by asking point."""
        own = d.argmin(1)
        near = d[np.arange(len(d)), own]
        some = d[:, self.kinds]
        gap = self.apart[own][:, self.kinds]
        with np.errstate(divide="ignore", invalid="ignore"):
            border = np.where(gap > 0, (some**2 - near[:, None] ** 2) / (2 * gap), 0.0)
        return np.maximum(np.maximum(border, 0), np.maximum(some - self.cell_high, self.cell_low - some))

    def reach(self, d: np.ndarray, k: int) -> np.ndarray:
        """A bound on the distance to the k-th point: that many are in cells no farther off."""
        most = d[:, self.kinds] + self.cell_high
        order = np.argsort(most, axis=1)
        enough = np.cumsum(self.cell_n[order], axis=1) >= k
        at = np.where(enough.any(1), enough.argmax(1), 0)
        found = most[np.arange(len(d)), order[np.arange(len(d)), at]]
        return np.where(enough.any(1), found, np.inf)

    def rings(self, d: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Asking points and the rings that they go to: those not farther than their bound."""
        limit = bound * (1 + 1e-9) + self.slack
        who, cell = np.nonzero(self.least(d) <= limit[:, None])
        ends = np.append(self.first[1:], len(self.cell))
        many = (ends - self.first)[cell]
        ring = np.repeat(self.first[cell] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        who = np.repeat(who, many)
        away = d[who, self.cell[ring]]
        good = np.maximum(away - self.high[ring], self.low[ring] - away) <= limit[who]
        return who[good], self.order[ring[good]]


class Cells:
    """An index of a table with a key and features array<double>; columns in keep go along."""

    def __init__(self, table: DataFrame, *, key: str = "seq_id", keep: tuple[str, ...] = (), block: int | None = None, most_cells: int = MOST_CELLS):
        self.key, self.keep, self.block = key, keep, block or BLOCK
        rows = table.select(key, "features", *keep)
        self.n = rows.count()
        self.spark = table.sparkSession
        self.compared = 0  # pairs that met in chunks, over all joins
        self.met = False  # whether the last join was one of blocks
        self.whole = self.n <= self.block
        if self.whole:
            self.table = rows
            return
        self._build(rows, min(most_cells, max(1, int(self.n**0.5))))

    def _build(self, rows: DataFrame, pivots: int) -> None:
        key, kept = self.key, [self.key, "features", *self.keep]
        chosen = rows.select(key, "features").orderBy(F.xxhash64(key), key).limit(pivots)  # a bounded number of rows
        points = np.array([r["features"] for r in chosen.collect()], float)
        kinds = [rows.schema[c].dataType.simpleString() for c in kept]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = matrix(part.column(1))
                    cell = distances(x, points).argmin(1)
                    away = np.sqrt(((x - points[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], names=names)

        names = [*(f"k{i}" for i in range(len(kept))), "__cell", "__away"]
        schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "__cell int", "__away double"])
        placed = settled(rows.select(*kept).mapInArrow(place, schema).toDF(*kept, "__cell", "__away"))
        cuts = [i / RINGS for i in range(1, RINGS)]
        sizes = placed.groupBy("__cell").agg(F.count("*").alias("n"), F.percentile_approx("__away", cuts, 1000).alias("cuts")).collect()  # a row to a cell
        borders = []
        for r in sizes:
            rings = int(min(RINGS, max(1, r["n"] // _RING)))
            borders.append((r["__cell"], sorted({r["cuts"][i * RINGS // rings - 1] for i in range(1, rings)})))
        table = F.broadcast(self.spark.createDataFrame(borders, "__cell int, __cuts array<double>"))
        ring = (F.col("__cell") * RINGS + F.size(F.filter("__cuts", lambda c: c < F.col("__away")))).cast("int")
        ringed = placed.join(table, "__cell").select(*kept, ring.alias("__ring"), "__cell", "__away")
        found = ringed.groupBy("__ring").agg(F.first("__cell").alias("cell"), F.min("__away").alias("low"), F.max("__away").alias("high"), F.count("*").alias("n")).collect()  # a row to a ring
        found.sort(key=lambda r: r["__ring"])
        self.ring = np.array([r["__ring"] for r in found], np.int32)
        self.size = np.array([r["n"] for r in found], np.int64)
        self.bounds = Bounds(points, *(np.array([r[c] for r in found]) for c in ("cell", "low", "high", "n")))
        self.chunks = np.maximum(1, -(-self.size // self.block))
        self.table = ringed.select(*kept, "__ring")

    def dense(self, width: float, least: int) -> list[int]:
        """Rings of at least so many points no two of which are farther apart than width."""
        if self.whole:
            return []
        high, n = np.empty(len(self.ring)), np.empty(len(self.ring), np.int64)
        high[self.bounds.order], n[self.bounds.order] = self.bounds.high, self.bounds.n
        return self.ring[(2 * high <= width) & (n >= least)].tolist()

    def share(self, asked: int | None = None) -> float:
        """Pairs compared so far over all pairs (of one join, of as many asking points)."""
        return self.compared / max(1, self.n * (self.n if asked is None else asked))

    def join(self, asks: DataFrame, run: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.Table], schema: str, *, bound: Column | float | None = None, near: int = 0, home: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
        """What run returns for asking points (the key, features, __bound and the columns of keep)
        and a chunk of the index, each with its matrix, for all chunks that may hold a point
        within the bound. near: a bound that as many points are within, taken if it is lower. home: one
        chunk of the nearest cell only. Every asking point meets each chunk that it goes to once."""
        key, kept = self.key, [self.key, "features", *keep]
        limit = F.lit(float("inf")) if bound is None else (bound if isinstance(bound, Column) else F.lit(float(bound)))
        rows = asks.select(*kept, limit.cast("double").alias("__bound"))
        kinds = [rows.schema[c].dataType.simpleString() for c in kept]
        names = [*kept, "__bound"]
        if self.whole:
            self.compared += self.n * (rows.count() if self.n else 0)
            return self._with_all(rows, run, schema, names)
        b, ring, key_names = self.bounds, self.ring, [f"k{i}" for i in range(len(kept))]
        if not home:
            asking = rows.count()
            self.met = self._blocks_cost_less(rows, asking, near)
            if self.met:
                self.compared += asking * self.n
                return meeting(rows, self.table.select(key, "features", *self.keep), asking, self.n, run, schema, key=key, block=self.block)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    d = distances(matrix(part.column(1)), b.pivots)
                    limit = part.column(len(kept)).to_numpy(zero_copy_only=False)
                    if near:
                        limit = np.minimum(limit, b.reach(d, near))
                    if home:
                        cell = b.nearest_cell(d)
                        lo, hi = np.searchsorted(b.cell, cell), np.searchsorted(b.cell, cell, side="right")
                        own = d[np.arange(len(d)), cell]
                        to = [[int(ring[b.order[x + int(np.argmin(np.maximum(b.low[x:y] - v, v - b.high[x:y])))]])] for x, y, v in zip(lo, hi, own, strict=True)]
                    else:
                        who, found = b.rings(d, limit)
                        ends = np.searchsorted(who, np.arange(len(d) + 1))
                        to = [ring[found[x:y]].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(limit, pa.float64()), pa.array(to, pa.list_(pa.int32()))], names=[*key_names, "__bound", "__to"])

        schema_ = ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "__bound double", "__to array<int>"])
        routed = settled(rows.mapInArrow(route, schema_).toDF(*names, "__to"))
        asked = {r["ring"]: r["count"] for r in routed.select(F.explode("__to").alias("ring")).groupBy("ring").count().collect()}  # a row to a ring
        plan = []
        for r, n, chunks in zip(self.ring.tolist(), self.size.tolist(), self.chunks.tolist(), strict=True):
            if r in asked:
                plan.append((r, -(-asked[r] // ASKING), 1 if home else chunks, chunks))
                self.compared += asked[r] * n // (chunks if home else 1)
        plan = F.broadcast(self.spark.createDataFrame(plan, "__ring int, __parts int, __chunks int, __all int"))
        left = routed.select(*names, F.explode("__to").alias("__ring")).join(plan, "__ring")
        left = left.select(*names, "__ring", _deal(key, "asks", F.col("__parts")).alias("__part"), F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"))
        right = self.table.join(plan, "__ring").select(key, "features", *self.keep, "__ring", _deal(key, "index", F.col("__all")).alias("__chunk"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), F.col("__chunks").alias("__upto"))
        right = right.where("__chunk < __upto").drop("__upto")
        return _grouped(left, right, ["__ring", "__chunk", "__part"], run, schema)

    def _blocks_cost_less(self, rows: DataFrame, asking: int, near: int) -> bool:
        """Rows sent and pairs compared by rings, reckoned from some asking points, against blocks."""
        tried = rows.select("features", "__bound").orderBy(F.xxhash64(self.key), self.key).limit(_TRIED).toArrow()  # a bounded number of rows
        if not tried.num_rows:
            return False
        d, limit = distances(matrix(tried.column("features")), self.bounds.pivots), tried.column("__bound").to_numpy()
        if near:
            limit = np.minimum(limit, self.bounds.reach(d, near))
        asked = np.zeros(len(self.ring))
        for at in range(0, len(d), 64):
            asked += np.bincount(self.bounds.rings(d[at : at + 64], limit[at : at + 64])[1], minlength=len(self.ring))
        asked *= asking / len(d)
        by_rings = _ROW * ((asked * self.chunks).sum() + (self.size * np.ceil(asked / ASKING)).sum()) + (asked * self.size).sum()
        return _ROW * (asking * _blocks(self.n, self.block) + self.n * _blocks(asking, self.block)) + asking * self.n < by_rings

    def _with_all(self, rows: DataFrame, run: Callable, schema: str, names: list[str]) -> DataFrame:
        """An index of one chunk goes to every task."""
        other = self.table.toArrow()  # BLOCK rows at most
        sent = self.spark.sparkContext.broadcast(other)
        empty = _empty(schema)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            other = sent.value
            y = matrix(other.column("features")) if other.num_rows else None
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    own = pa.Table.from_batches([batch.slice(at, BLOCK)]).rename_columns(names)
                    if other.num_rows:
                        yield from run(own, matrix(own.column("features")), other, y).cast(empty.schema).to_batches()

        return rows.mapInArrow(meet, schema)


_ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def _empty(schema: str) -> pa.Table:
    return pa.schema([(c.rsplit(" ", 1)[0].strip("`"), _ARROW[c.rsplit(" ", 1)[1]]) for c in schema.split(", ")]).empty_table()


class Near:
    """Squared distances of asking rows from other rows in single precision, some rows at a time, less
    the square of the asking row, and how far these may be off by rounding. Both are moved to the middle and scaled to one."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        middle = y.mean(0)
        x, y = x - middle, y - middle
        self.scale = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) or 1.0
        x, y = x / self.scale, y / self.scale
        self.size_x, size_y = (x * x).sum(1), (y * y).sum(1)
        self.left = np.column_stack([-2 * x, np.ones(len(x))]).astype(np.float32)
        self.right = np.ascontiguousarray(np.column_stack([y, size_y]).astype(np.float32).T)
        most = size_y.max(initial=0)
        self.off = (x.shape[1] + 8) * 2.0**-22 * (2 * np.sqrt(self.size_x * most) + most + self.size_x) + 1e-30
        self.step = max(16, _STEP // max(1, len(y)))

    def steps(self) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(self.left), self.step):
            some = slice(at, at + self.step)
            yield some, self.left[some] @ self.right


def squares(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of given pairs, by their differences."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        some = slice(at, at + (1 << 15))
        out[some] = ((x[i[some]] - y[j[some]]) ** 2).sum(1)
    return out


def where(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true."""
    return np.divmod(np.flatnonzero(good), good.shape[1])


def nearest(x: np.ndarray, y: np.ndarray, rank: np.ndarray, k: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Asking rows, rows of y and distances of the k nearest; of equal ones the lowest rank.
    same: for each asking row the row of y that is itself, or -1."""
    out, many = [], len(y)
    k = min(k, many)
    if not len(x) or not k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    near = Near(x, y)
    lanes = min(many, max(1_024, 8 * k))  # least values of as many parts of y; the k-th of them is no less than the k-th of all
    for some, square in near.steps():
        if same is not None:
            own = np.flatnonzero(same[some] >= 0)
            square[own, same[some][own]] = np.inf
        low = square[:, : many // lanes * lanes].reshape(len(square), -1, lanes).min(axis=1)
        least = low.min(axis=1) if k == 1 else np.partition(low, k - 1, axis=1)[:, k - 1]
        i, j = where(square <= np.nextafter((least + 2 * near.off[some]).astype(np.float32), np.float32(np.inf))[:, None])
        good = np.isfinite(square[i, j])
        i, j = i[good], j[good]
        d = np.sqrt(squares(x, some.start + i, y, j))
        order = np.lexsort((rank[j], d, i))
        i, j, d = i[order], j[order], d[order]
        good = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((some.start + i[good], j[good], d[good]))
    return tuple(np.concatenate(v) for v in zip(*out))


def place_of(wanted: pa.ChunkedArray, values: pa.ChunkedArray) -> np.ndarray:
    """Where each value stands, -1 for none."""
    return pc.fill_null(pc.index_in(wanted, values.combine_chunks()), -1).to_numpy().astype(np.int64)


def rank_of(values: pa.ChunkedArray) -> np.ndarray:
    """The rank of each value in their order."""
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank
