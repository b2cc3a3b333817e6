"""Neighbouring matches: distances, junction rules, primer windows, trimming.

Adjacency is lead() within a read in a total order (position, then name, then length),
so there is one shuffle by read and no self join. Rules are small tables and are
joined by broadcast after a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.functions.sequence import iupac_reverse_complement, sliced
from seqframe.scratch import settled, small

ORDER = ("position", "query_name", "length")


def without_barcodes(matches: DataFrame, word: str = "Barcode") -> DataFrame:
    """Case matters."""
    return matches.where(~F.col("query_name").contains(word))


def adjacent(matches: DataFrame, *, key: str | list[str] = "seq_id", order=ORDER) -> DataFrame:
    """Each match with the next one of its read (next_name, next_position, next_length
    and three distances: gap, abs_gap, start_delta) and n_matches. Last ones stay out."""
    keys = [key] if isinstance(key, str) else key
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = matches.withColumns({f"next_{n}": F.lead(c).over(by) for n, c in (("name", "query_name"), ("position", "position"), ("length", "length"))})
    rows = rows.withColumn("n_matches", F.count("*").over(Window.partitionBy(*keys)))
    gap = F.col("next_position") - (F.col("position") + F.col("length"))
    return rows.where("next_name is not null").withColumns({"gap": gap, "abs_gap": F.abs(gap), "start_delta": F.col("next_position") - F.col("position")})


def at_least(matches: DataFrame, n: int, *, key: str = "seq_id") -> DataFrame:
    """Matches of reads that have n or more."""
    return matches.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") >= n).drop("__n")


def reads_with_all(matches: DataFrame, direct: list[str], reverse: list[str] | None = None, *, key: str = "seq_id") -> DataFrame:
    """Reads that have every name of a set: key, direct, reverse booleans."""

    def has(names: list[str] | None) -> Column:
        if not names:
            return F.lit(False)
        return F.size(F.array_except(F.array(*map(F.lit, names)), F.collect_set("query_name"))) == 0

    return matches.groupBy(key).agg(has(direct).alias("direct"), has(reverse).alias("reverse")).where("direct or reverse")


def selected_reads(reads: DataFrame, direct: DataFrame, reverse: DataFrame, *, key: str = "rec_no") -> DataFrame:
    """Reads by key: those in direct as they are, those in reverse turned, their id with
    _RC. A read in both comes twice; orientation says which."""
    one = reads.join(direct.select(key).distinct(), key, "left_semi").withColumn("orientation", F.lit("direct"))
    two = reads.join(reverse.select(key).distinct(), key, "left_semi")
    two = two.withColumns({"seq": iupac_reverse_complement("seq"), "qual": F.reverse("qual"), "read_id": F.concat("read_id", F.lit("_RC")), "orientation": F.lit("reverse")})
    return one.unionByName(two)


def gap_filter(matches: DataFrame, threshold: int, *, key: str = "seq_id") -> DataFrame:
    """Both ends of each adjacent pair whose gap reaches the threshold; a match between
    two such gaps comes twice."""
    pairs = adjacent(matches, key=key).where(F.col("gap") >= threshold)
    ends = F.array(
        F.struct(F.col("query_name"), F.col("position"), F.col("length")),
        F.struct(F.col("next_name").alias("query_name"), F.col("next_position").alias("position"), F.col("next_length").alias("length")),
    )
    return pairs.select(key, F.explode(ends).alias("m")).select(key, "m.*")


def junctions(matches: DataFrame, rules: DataFrame, low: int, high: int, *, include: bool = False, min_matches: int = 3, key: str = "seq_id") -> DataFrame:
    """Regions between (or over, with include) neighbours that a rule names, with a gap
    in [low, high]; only reads with min_matches or more. Distinct."""
    pairs = adjacent(matches, key=key).where((F.col("n_matches") >= min_matches) & F.col("gap").between(low, high))
    pairs = pairs.join(small(rules.select(F.col("start").alias("query_name"), F.col("end").alias("next_name"), "orientation")), ["query_name", "next_name"])
    start = F.col("position") if include else F.col("position") + F.col("length")
    end = F.col("next_position") + F.col("next_length") if include else F.col("next_position")
    return pairs.select(key, start.alias("start_pos"), end.alias("end_pos"), "orientation").distinct()


def primer_pairs(matches: DataFrame, least: int, *, outer: bool = False, key: str = "seq_id") -> DataFrame:
    """Regions of neighbouring primers after barcodes are gone, with abs_gap at least
    `least`. Inner: RCRight-RCLeft or Left-Right, the span between. Outer: any of Left,
    RCRight before any of Right, RCLeft, the span over both."""
    pairs = adjacent(without_barcodes(matches), key=key).where(F.col("abs_gap") >= least)
    a, b = F.col("query_name"), F.col("next_name")
    if outer:
        pairs = pairs.where(a.isin("Left", "RCRight") & b.isin("Right", "RCLeft"))
        return pairs.select(key, F.col("position").alias("start_pos"), (F.col("next_position") + F.col("next_length")).alias("end_pos"))
    pairs = pairs.where(((a == "RCRight") & (b == "RCLeft")) | ((a == "Left") & (b == "Right")))
    return pairs.select(key, (F.col("position") + F.col("length")).alias("start_pos"), F.col("next_position").alias("end_pos"))


def primer_windows(matches: DataFrame, rules: DataFrame, *, min_matches: int = 3, key: str = "seq_id") -> DataFrame:
    """Regions from the end of each named primer as far as its rule says. Distinct."""
    rows = at_least(matches, min_matches, key=key).join(small(rules.withColumnRenamed("primer", "query_name")), "query_name")
    end = F.col("position") + F.col("length")
    return rows.select(key, end.alias("start_pos"), (end + F.col("distance_max")).alias("end_pos"), "orientation").distinct()


def junction_sweep(matches: DataFrame, rules: DataFrame, most: int = 5, *, min_matches: int = 3, key: str = "seq_id") -> DataFrame:
    """Regions for every gap of 0 to most in one pass: gap, regions, reads."""
    pairs = adjacent(matches, key=key).where((F.col("n_matches") >= min_matches) & F.col("gap").between(0, most))
    pairs = pairs.join(small(rules.select(F.col("start").alias("query_name"), F.col("end").alias("next_name"), "orientation")), ["query_name", "next_name"])
    regions = pairs.select(key, "gap", (F.col("position") + F.col("length")).alias("a"), F.col("next_position").alias("b"), "orientation").distinct()
    return regions.groupBy("gap").agg(F.count("*").alias("n_regions"), F.countDistinct(key).alias("n_reads"))


def trimmed(reads: DataFrame, regions: DataFrame, *, key: str = "seq_id", drop_short: bool = True, quality_mode: str = "reversed", renumber: bool = True) -> DataFrame:
    """The regions cut out of the reads: seq and qual, turned where orientation is
    'reverse' (qualities with the bases, or left as they are with quality_mode
    'reference'). Slices that run past the read are dropped or kept short. With renumber
    read_id becomes 1, 2, ... in the order of key and region."""
    if quality_mode not in ("reversed", "reference"):
        raise ValueError(f"no quality mode {quality_mode!r}")
    turn = F.col("orientation") == "reverse" if "orientation" in regions.columns else F.lit(False)
    rows = reads.join(regions, key)
    want = F.col("end_pos") - F.col("start_pos")
    seq = sliced("seq", F.col("start_pos"), F.col("end_pos"))
    qual = sliced("qual", F.col("start_pos"), F.col("end_pos"))
    rows = rows.where(want > 0).withColumns({"seq": seq, "qual": qual})
    rows = rows.where(F.length("seq") == want) if drop_short else rows.where("length(seq) > 0")
    rows = rows.withColumn("seq", F.when(turn, iupac_reverse_complement("seq")).otherwise(F.col("seq")))
    if quality_mode == "reversed":
        rows = rows.withColumn("qual", F.when(turn, F.reverse("qual")).otherwise(F.col("qual")))
    return numbered(rows, [key, "start_pos", "end_pos"]) if renumber else rows


def numbered(rows: DataFrame, order: list[str], name: str = "read_id") -> DataFrame:
    """1, 2, ... as text in a total order. Rows are dealt by range, written with the number
    of their range, and counted, so that no task sees all; what is lost later is read again,
    not dealt again."""
    ranged = settled(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (own + F.col("__before")).cast("string")).drop("__part", "__before")


def pair_statistics(matches: DataFrame, *, key: str = "seq_id", value: str = "gap") -> DataFrame:
    """By pair of neighbours: count, mean, population deviation, least, greatest, median."""
    v = F.col(value)
    stats = adjacent(matches, key=key).groupBy(F.col("query_name").alias("from_name"), F.col("next_name").alias("to_name"))
    return stats.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"))


def by_pair(rows: DataFrame, pairs: DataFrame, *, keep: bool = True) -> DataFrame:
    """Rows whose (from_name, to_name) is in the list, or is not."""
    return rows.join(small(pairs.select("from_name", "to_name").distinct()), ["from_name", "to_name"], "left_semi" if keep else "left_anti")


def barcode_distances(matches: DataFrame, *, barcode: str = "barcode", key: str = "seq_id", word: str = "Barcode") -> DataFrame:
    """Start deltas of neighbours by barcode, barcode motifs removed."""
    rows = adjacent(without_barcodes(matches, word), key=[barcode, key])
    return rows.select(barcode, F.col("query_name").alias("from_name"), F.col("next_name").alias("to_name"), F.col("start_delta").alias("distance"))


def distance_pivot(distances: DataFrame, names: list[str], *, by: str = "from_name") -> DataFrame:
    """Mean distance from each name to each other one; names are the columns."""
    return distances.groupBy(by).pivot("to_name", names).agg(F.avg("distance"))


def count_pivot(distances: DataFrame, names: list[str], *, by: str = "from_name") -> DataFrame:
    return distances.groupBy(by).pivot("to_name", names).agg(F.count(F.lit(1))).fillna(0)
