"""Statistics over matches, reads and feature tables. Built-in aggregates only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.scratch import settled


def motif_statistics(matches: DataFrame) -> DataFrame:
    """By motif: rounded mean, median, extremes and sample deviation of the position, count."""
    p = F.col("position")
    return matches.groupBy("query_name").agg(
        F.round(F.avg(p)).alias("avg_pos"), F.median(p).alias("median_pos"), F.min(p).alias("min_pos"), F.max(p).alias("max_pos"), F.stddev_samp(p).alias("std_pos"), F.count("*").alias("n")
    )


def barcode_statistics(matches: DataFrame, reads: DataFrame, *, barcode: str = "barcode", key: str = "seq_id") -> DataFrame:
    """By barcode and motif: matches, mean score and length, and the barcode's reads,
    those without matches too."""
    n = reads.groupBy(barcode).agg(F.countDistinct(key).alias("n_reads"))
    stats = matches.groupBy(barcode, "query_name").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.avg("length").alias("avg_length"))
    return stats.join(n, barcode)


def distinct_motifs(matches: DataFrame) -> DataFrame:
    return matches.select("query_name").distinct().orderBy("query_name")


def describe(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles, greatest."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    return out.withColumns({"q25": F.col("q")[0], "q50": F.col("q")[1], "q75": F.col("q")[2]}).drop("q")


def box_statistics(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Five numbers by group: quartiles, and the outermost values within 1.5 quartile
    distances of them; and how many values lie beyond."""
    v = F.col(value)
    q = describe(rows, value, by).select(*by, "q25", "q50", "q75")
    joined = rows.join(q, by)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = v.between(F.col("q25") - reach, F.col("q75") + reach)
    return joined.groupBy(*by, "q25", "q50", "q75").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, which is in the last
    bin; one value only: all in bin 0. Empty bins are absent."""
    v = F.col(value).cast("double")
    ends = rows.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    at = F.least(F.coalesce(F.floor(F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins), F.lit(0)), F.lit(bins - 1))
    return rows.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def length_outliers(reads: DataFrame, limit: float = 2.0, seq: str = "seq") -> DataFrame:
    """Reads whose length is less than `limit` population deviations from the mean; none
    if all have one length."""
    n = F.length(seq)
    total = reads.agg(F.avg(n).alias("__mean"), F.stddev_pop(n).alias("__std"))
    z = F.abs(F.try_divide(n - F.col("__mean"), F.col("__std")))
    return reads.crossJoin(F.broadcast(total)).where(z < limit).drop("__mean", "__std")


def length_summary(reads: DataFrame, seq: str = "seq") -> DataFrame:
    n = F.length(seq)
    return reads.agg(F.count("*").alias("n_reads"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("bases"))


def cluster_sizes(assigned: DataFrame, key: str = "seq_id") -> DataFrame:
    return assigned.groupBy("cluster").agg(F.countDistinct(key).alias("n_reads"))


def cluster_summary(assigned: DataFrame, key: str = "seq_id") -> DataFrame:
    """Reads, clusters (noise -1 left out), mean and greatest size."""
    sizes = cluster_sizes(assigned.where("cluster >= 0"), key)
    return sizes.agg(F.coalesce(F.sum("n_reads"), F.lit(0)).alias("n_reads"), F.count("*").alias("n_clusters"), F.avg("n_reads").alias("mean_size"), F.max("n_reads").alias("max_size"))


def distinct_counts(matches: DataFrame, key: str = "seq_id") -> DataFrame:
    return matches.agg(F.countDistinct(key).alias("n_reads"), F.countDistinct("query_name").alias("n_motifs"), F.count("*").alias("n_matches"))


def top_clusters(assigned: DataFrame, k: int = 30, key: str = "seq_id") -> DataFrame:
    """Rows of the k largest clusters; ties go to the smaller number."""
    best = cluster_sizes(assigned, key).orderBy(F.desc("n_reads"), "cluster").limit(k)
    return assigned.join(F.broadcast(best.select("cluster")), "cluster", "left_semi")


def features(matches: DataFrame, names: list[str], width: Column | float | None = None, *, key: str = "seq_id") -> DataFrame:
    """By read and motif: mean and population deviation of position / width, mean score
    and length, 0 where there is no match. Columns are <name>_pos, _std, _score, _len.
    Without a width, it is the greatest end of any match."""
    rows = matches
    if width is None:
        rows = rows.crossJoin(F.broadcast(matches.agg(F.max(F.col("position") + F.col("length")).cast("double").alias("__w"))))
        width = F.col("__w")
    p = F.col("position") / width
    wide = rows.groupBy(key).pivot("query_name", names).agg(F.avg(p).alias("pos"), F.stddev_pop(p).alias("std"), F.avg("score").alias("score"), F.avg("length").alias("len"))
    return wide.fillna(0.0)


def standardized(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1; constant ones to 0."""
    stats = table.agg(*[F.avg(c).alias(f"__m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"__s{k}") for k, c in enumerate(columns)])
    out = table.crossJoin(F.broadcast(stats))
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m{k}"), F.col(f"__s{k}")), F.lit(0.0)) for k, c in enumerate(columns)}
    return out.withColumns(z).select(*table.columns)


def ranged(rows: DataFrame, conditions: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with every named column within its closed range."""
    for name, (low, high) in conditions.items():
        rows = rows.where(F.col(name).between(low, high))
    return rows


def quantile(rows: DataFrame, column: str, q: float, *, most: int = 10_000, slots: int = 1_000) -> float | None:
    """The exact quantile (linear between two values) of a column of doubles, null without values.
    Rounds of counts by range close in on the wanted ranks until at most `most` different values are left
    there; only those come to the driver, with their counts."""
    values = settled(rows.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = q * (n - 1)
    below = 0  # values under low
    while low < high:
        some = values.where(F.col("v").between(low, high))
        left = some.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").limit(most + 1).collect()
        if len(left) <= most:
            ends = list(accumulate((r["n"] for r in left), initial=below))[1:]
            pick = lambda rank: next(r["v"] for r, end in zip(left, ends, strict=True) if rank < end)
            a, b = pick(int(at)), pick(min(n - 1, int(at) + 1))
            return a + (b - a) * (at - int(at))
        slot = F.least(F.floor((F.col("v") - low) / ((high - low) / slots)), F.lit(slots - 1)).cast("int")
        counts = some.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s").collect()  # a row to a slot
        ends = list(accumulate((r["n"] for r in counts), initial=below))
        first = next(k for k in range(len(counts)) if int(at) < ends[k + 1])
        last = next(k for k in range(len(counts)) if min(n - 1, int(at) + 1) < ends[k + 1])
        below, now = ends[first], (counts[first]["lo"], counts[last]["hi"])
        if now == (low, high):
            most *= 4  # values too close together for ranges
        low, high = now
    return low


def sample_of(rows: DataFrame, n: int, *, key: str, seed: int = 42, most: int = 10_000) -> DataFrame:
    """n rows that depend on the key and the seed only: those of least hash, and of equal ones of
    least key. Large samples are no sort of all rows: counts by the hash's leading bits, in rounds, lead to a
    cut-off, below which all rows are taken; only the last few are sorted."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    if n <= most:
        return rows.orderBy(h, key).limit(n)  # kept as the least n of each task
    low, bits, below = -(1 << 63), 64, 0  # hashes from low on that agree with it but for `bits` bits
    while True:
        inside = F.shiftright(h, bits) == low >> bits if bits < 64 else F.lit(True)
        bits -= 12 if bits > 12 else bits
        counts = rows.where(inside).groupBy(F.shiftright(h, bits).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # 4,096 rows at most
        ends = list(accumulate((r["n"] for r in counts), initial=below))
        if ends[-1] <= n:
            return rows if low == -(1 << 63) and bits >= 52 else rows.where(h < F.lit(low)).union(rows.where(inside))
        at = next(k for k in range(len(counts)) if n < ends[k + 1])
        low, below = counts[at]["b"] << bits, ends[at]
        if counts[at]["n"] <= most or not bits:
            last = rows.where(F.shiftright(h, bits) == low >> bits).orderBy(h, key).limit(n - below)
            return rows.where(h < F.lit(low)).union(last)


def sample_per_cluster(rows: DataFrame, n: int, *, key: str = "seq_id", seed: int = 42) -> DataFrame:
    """At most n reads of each cluster, chosen by hash. Reads are chosen apart from their rows, the
    first n of each share of a cluster first, so that no task sees a whole cluster."""
    reads = rows.select("cluster", key).distinct().withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    reads = reads.withColumn("__s", F.pmod("__h", F.lit(256)))
    for by in (["cluster", "__s"], ["cluster"]):
        order = Window.partitionBy(*by).orderBy("__h", key)
        reads = reads.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    chosen = reads.select(F.col("cluster").alias("__c"), F.col(key).alias("__k"))
    return rows.join(chosen, F.col("cluster").eqNullSafe(F.col("__c")) & F.col(key).eqNullSafe(F.col("__k")), "left_semi")
