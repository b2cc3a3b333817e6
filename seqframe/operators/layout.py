"""Relations behind heatmaps, boxes and density plots. Drawing is left to others."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.operators.pairs import numbered
from seqframe.operators.stats import sample_of, sample_per_cluster, top_clusters
from seqframe.scratch import dealt, small


def with_clusters(matches: DataFrame, assigned: DataFrame, *, key: str = "seq_id") -> DataFrame:
    return matches.join(assigned.select(key, "cluster"), key)


def with_query_index(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """query_idx by motif; unknown motifs are dropped."""
    return matches.join(small(queries.select("query_name", "query_idx")), "query_name")


def row_index(matches: DataFrame, *, key: str = "seq_id", by: str | None = "cluster", first: str | None = None) -> DataFrame:
    """A dense row number from 0 for each read, in the order of cluster and read, or of the
    least `first` of each read (as the reads are first seen). Reads are ranked in two steps,
    within ranges and over the ranges' sizes, so that no task sees all."""
    if first:
        seen = matches.groupBy(key).agg(F.min(first).alias("__first"))
        return matches.join(numbered(seen, ["__first", key], "__n").select(key, (F.col("__n").cast("int") - 1).alias("row")), key)
    order = [by, key] if by else [key]
    rows = numbered(matches.select(*order).distinct(), order, "__n").select(*order, (F.col("__n").cast("int") - 1).alias("row"))
    return matches.join(rows, order)


def boxes(matches: DataFrame) -> DataFrame:
    """x_start, x_end, x_mid and y edges of each match; needs row."""
    end = F.col("position") + F.col("length")
    return matches.withColumns({"x_start": F.col("position"), "x_end": end, "x_mid": (F.col("position") + end) / 2.0, "y_bottom": F.col("row") - 0.4, "y_top": F.col("row") + 0.4})


def visual_width(matches: DataFrame, *, key: str = "seq_id", mode: str = "max") -> DataFrame:
    """One number: the greatest end ('max'), or 1.1 times the mean of the reads' greatest
    ends ('mean'), both cut to whole numbers."""
    ends = matches.groupBy(key).agg(F.max(F.col("position") + F.col("length")).alias("end"))
    if mode == "max":
        return ends.agg(F.max("end").cast("int").alias("width"))
    if mode == "mean":
        return ends.agg((F.avg("end").cast("int") * F.lit(1.1)).cast("int").alias("width"))
    raise ValueError(f"no width {mode!r}")


def raster(matches: DataFrame, width: int | None, *, order: list[str], key: str = "seq_id") -> DataFrame:
    """key, pos, query_idx, length for each covered cell left of width (None: the greatest
    end, so that no cell is left out); where matches overlap, the last one in the given order."""
    end = F.col("position") + F.col("length")
    last = (end if width is None else F.least(end, F.lit(width))) - 1
    within = F.lit(True) if width is None else F.col("position") < width
    cells = matches.where(within & (F.col("length") > 0)).select(key, F.explode(F.sequence(F.col("position"), last)).alias("pos"), F.struct(*order).alias("__o"), "query_idx", "length")
    top = F.max_by(F.struct("query_idx", "length"), "__o")
    return cells.groupBy(key, "pos").agg(top.alias("m")).select(key, "pos", "m.query_idx", "m.length")


def runs(cells: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """Runs of neighbouring raster cells of one motif: key, query_idx, start, size."""
    by = Window.partitionBy(key).orderBy("pos")
    new = ((F.col("pos") != F.lag("pos").over(by) + 1) | (F.col("query_idx") != F.lag("query_idx").over(by))).cast("int")
    rows = cells.withColumn("__run", F.sum(F.coalesce(new, F.lit(0))).over(by))
    return rows.groupBy(key, "__run", "query_idx").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("size")).drop("__run")


def walked_boxes(cells: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """Boxes as a reader of the raster finds them: at the first covered cell a box of its
    stored length begins, and the walk goes on behind it."""
    row = F.array_sort(F.collect_list(F.struct("pos", "query_idx", "length")))

    def step(state: Column, cell: Column) -> Column:
        take = cell["pos"] >= state["next"]
        found = F.when(take, F.concat(state["found"], F.array(cell))).otherwise(state["found"])
        return F.struct(found.alias("found"), F.when(take, cell["pos"] + cell["length"]).otherwise(state["next"]).alias("next"))

    start = F.struct(F.array().cast("array<struct<pos:int,query_idx:int,length:int>>").alias("found"), F.lit(0).alias("next"))
    rows = cells.select(key, F.col("pos").cast("int").alias("pos"), F.col("query_idx").cast("int").alias("query_idx"), F.col("length").cast("int").alias("length"))
    found = rows.groupBy(key).agg(F.aggregate(row, start, step, lambda s: s["found"]).alias("found"))
    return found.select(key, F.explode("found").alias("b")).select(key, F.col("b.pos").alias("start"), "b.query_idx", "b.length")


def walked_matches(matches: DataFrame, *, order: list[str], key: str = "seq_id") -> DataFrame:
    """walked_boxes() of the raster of whole matches, without its cells: matches are dealt by read and sorted by
    position, and the walk looks up the last one in the given order (of numbers) that covers its place. A task keeps
    the matches that cover one place."""
    rows = matches.where(F.col("position").isNotNull() & (F.col("length") > 0))
    whole = ["position", "length", "query_idx"]
    more = [c for c in order if c not in whole]
    places = [[*whole, *more].index(c) for c in order]
    rows = rows.select(key, *(F.col(c).cast("int").alias(f"__{c}") for c in whole), *(F.col(c).cast("double").alias(f"__{c}") for c in more))
    kind = rows.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, over, found = None, 0, [], ([], [], [], [])

        def go(upto: float) -> None:
            """Boxes that begin left of upto."""
            nonlocal at
            while over and at < upto:
                _, end, length, query = over[0]
                if end <= at:
                    heapq.heappop(over)
                    continue
                for column, value in zip(found, (now, at, query, length)):
                    column.append(value)
                at += length

        def boxes(own: pa.DataType) -> pa.RecordBatch:
            nonlocal found
            out, found = found, ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (own, pa.int32(), pa.int32(), pa.int32()))], names=[key, "start", "query_idx", "length"])

        first = True
        for batch in batches:
            for read, *values in zip(*(c.to_pylist() for c in batch.columns)):
                position, length, query = values[:3]
                if first or read != now:
                    go(float("inf"))
                    now, at, over, first = read, 0, [], False
                go(position)
                if not over:
                    at = max(at, position)
                heapq.heappush(over, ([-values[i] for i in places], position + length, length, query))
            own = batch.column(0).type
            yield boxes(own)
        go(float("inf"))
        if not first:
            yield boxes(own)

    rows = rows.repartition(key).sortWithinPartitions(key, "__position")
    return rows.mapInArrow(walk, f"`{key}` {kind}, start int, query_idx int, length int")


def merged(matches: DataFrame) -> DataFrame:
    """Compression 'merge': different (motif, position, length) of a cluster."""
    return matches.select("cluster", "query_name", "position", "length").distinct()


def most_matches(matches: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """Representative by cluster: the read with most matches, the smallest id of equals."""
    n = matches.groupBy("cluster", key).agg(F.count("*").alias("n"))
    return n.groupBy("cluster").agg(F.min_by(F.struct(key, "n"), F.struct(-F.col("n"), F.col(key))).alias("r")).select("cluster", f"r.{key}", "r.n")


def first_read(matches: DataFrame, *, key: str = "seq_id", ordinal: str = "rec_no") -> DataFrame:
    """Representative by cluster: the read that comes first."""
    return matches.groupBy("cluster").agg(F.min_by(key, F.struct(F.col(ordinal), F.col(key))).alias(key))


def compressed(matches: DataFrame, method: str, *, key: str = "seq_id", most: int = 50, seed: int = 42) -> DataFrame:
    """The rows of a cluster's picture: 'merge', 'representative' or 'sample'."""
    if method == "merge":
        return merged(matches)
    if method == "representative":
        return matches.join(most_matches(matches, key=key).select("cluster", key), ["cluster", key], "left_semi")
    if method == "sample":
        return sample_per_cluster(matches, most, key=key, seed=seed)
    raise ValueError(f"no compression {method!r}")


def thinned(matches: DataFrame, *, key: str = "seq_id", clusters: int = 30, reads: int = 50, most: int = 2000) -> DataFrame:
    """All rows if there are at most `most` reads, else the largest clusters with some
    reads of each."""
    if matches.select(key).distinct().limit(most + 1).count() <= most:
        return matches
    return sample_per_cluster(top_clusters(matches, clusters, key), reads, key=key)


def dashboard(matches: DataFrame, *, key: str = "seq_id", most: int = 100_000, upto: int | None = None) -> DataFrame:
    """Distinct points of a dashboard, at most so many, none that ends right of upto."""
    rows = matches.select("cluster", key, "query_name", "position", "length")
    rows = dealt(rows if upto is None else rows.where(F.col("position") + F.col("length") <= upto), key).distinct()
    return sample_of(rows.withColumn("__k", F.concat_ws("|", key, "query_name", "position")), most, key="__k").drop("__k")


def density(points: DataFrame, x: str, y: str, width: int, height: int, *, bounds: tuple[float, float, float, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """px, py (and by): n points in each pixel of a grid over the bounds (x from, x to, y
    from, y to; without them, over all points). The far edges belong to the last pixels."""
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if bounds is None:
        ends = points.agg(F.min(x).cast("double").alias("__x0"), F.max(x).cast("double").alias("__x1"), F.min(y).cast("double").alias("__y0"), F.max(y).cast("double").alias("__y1"))
        rows = rows.crossJoin(F.broadcast(ends))
    else:
        rows = rows.withColumns({f"__{n}": F.lit(float(v)) for n, v in zip(("x0", "x1", "y0", "y1"), bounds, strict=True)})
        rows = rows.where(F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1")))

    def pixel(v: str, lo: str, hi: str, n: int) -> Column:
        return F.least(F.coalesce(F.floor(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)) * n), F.lit(0)), F.lit(n - 1)).cast("int")

    return rows.groupBy(pixel(x, "__x0", "__x1", width).alias("px"), pixel(y, "__y0", "__y1", height).alias("py"), *(by or [])).agg(F.count("*").alias("n"))


def line_points(boxed: DataFrame, n: int = 10) -> DataFrame:
    """n points along each match, its ends among them."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    rows = boxed.select("*", k)
    return rows.withColumn("x", F.col("x_start") + F.col("k") * (F.col("x_end") - F.col("x_start")) / float(n - 1)).drop("k")


def spread(grid: DataFrame, px: int = 1, *, value: str = "n") -> DataFrame:
    """px, py, value: each pixel takes the greatest value within px pixels to every side."""
    near = F.sequence(F.lit(-px), F.lit(px))
    rows = grid.select("*", F.explode(near).alias("__dx")).select("*", F.explode(near).alias("__dy"))
    rows = rows.select((F.col("px") + F.col("__dx")).alias("px"), (F.col("py") + F.col("__dy")).alias("py"), value)
    return rows.where("px >= 0 and py >= 0").groupBy("px", "py").agg(F.max(value).alias(value))


def rectangle_density(boxed: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float], *, by: list[str] | None = None) -> DataFrame:
    """Matches as rectangles: every pixel column that one covers in its row counts once."""
    x0, x1, y0, y1 = map(float, bounds)
    px = lambda c: F.greatest(F.least(F.floor((c - x0) / (x1 - x0) * width), F.lit(width - 1)), F.lit(0)).cast("int")
    py = F.greatest(F.least(F.floor((F.col("row") - y0) / (y1 - y0) * height), F.lit(height - 1)), F.lit(0)).cast("int")
    rows = boxed.where((F.col("x_end") > x0) & (F.col("x_start") < x1))
    rows = rows.select(*(by or []), py.alias("py"), F.explode(F.sequence(px(F.col("x_start")), px(F.col("x_end") - 1))).alias("px"))
    return rows.groupBy("px", "py", *(by or [])).agg(F.count("*").alias("n"))


def shaded(grid: DataFrame, how: str = "log") -> DataFrame:
    """level 0 to 1 of each pixel that isn't empty: by log count, or by rank ('eq_hist')."""
    if how == "log":
        top = F.broadcast(grid.agg(F.max("n").alias("__top")))
        return grid.crossJoin(top).withColumn("level", F.log1p("n") / F.log1p("__top")).drop("__top")
    if how == "eq_hist":
        counts = grid.groupBy("n").agg(F.count("*").alias("__c"))
        ranks = counts.withColumn("level", F.sum("__c").over(Window.orderBy("n")) / F.sum("__c").over(Window.partitionBy())).drop("__c")
        return grid.join(small(ranks), "n")
    raise ValueError(f"no shading {how!r}")
