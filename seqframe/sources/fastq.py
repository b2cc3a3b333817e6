"""FASTQ and FASTA in and out.

FASTQ of four lines a record is read as text with line numbers: record = line div 4, so
that quality lines that begin with @ do no harm and files split anywhere. Lines are
numbered by the split they come from: the lines of each split are counted, which is one number to a
split, and a line's number is its place in the split after all splits before. Both passes are plain text scans in the
JVM. Numbering goes by file; over several files rec_no restarts in each and barcode is the file's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqframe.schema import FASTA, READ
from seqframe.scratch import small


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """file, at (where the split begins), i (growing with the place in the split), line."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    return rows.select("file", "at", "i", F.rtrim("value", F.lit("\r")).alias("line"))


def _before(splits: DataFrame, count: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """file, at, first (the least i), name: what count adds up to in all splits before (of the file, if `by`
    names it). A row to a split."""
    counts = splits.groupBy("file", "at").agg(F.min("i").alias("first"), count.alias("__n"))
    before = Window.partitionBy(*by).orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    return small(counts.select("file", "at", "first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(name)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """no, line: numbered lines of one file (or of the files of a folder in the order of names)."""
    splits = _splits(spark, path)
    return splits.join(_before(splits, F.count("*"), "before"), ["file", "at"]).select((F.col("before") + F.col("i") - F.col("first")).alias("no"), "line")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """rec_no (from 0), read_id, description, seq, qual. Records without four lines, or whose
    lines don't begin as they should, raise an error when they are read."""
    return fastq_records(_lines(spark, path))


def fastq_records(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The records of numbered lines (no from 0, line), and of several files if `by` names them."""
    at = F.col("no") % 4
    records = lines.groupBy(*by, F.expr("no div 4").alias("rec_no")).agg(*[F.max(F.when(at == k, F.col("line"))).alias(n) for k, n in enumerate(("head", "seq", "plus", "qual"))])
    records = records.where("not (head = '' and seq is null)")
    good = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    records = records.withColumn("head", F.when(F.coalesce(good, F.lit(False)), F.col("head")).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.col("rec_no").cast("string")))))
    description = F.substring("head", 2, 1 << 30)
    return records.select(*by, "rec_no", F.split(description, r"\s+")[0].alias("read_id"), description.alias("description"), "seq", "qual")


def read_fastq_files(spark: SparkSession, pattern: str, *, path: bool = False) -> DataFrame:
    """Many FASTQ files at once: the columns of read_fastq and barcode, the file's name
    without its ending (and path, if asked for). Numbers restart in each file. Files of any size are read by their
    splits, each of which counts its lines; a record that is cut short raises an error as in
    read_fastq. Empty lines at a file's end are left out."""
    splits = _splits(spark, pattern)
    lines = splits.join(_before(splits, F.count("*"), "before", ("file",)), ["file", "at"])
    lines = lines.select(F.col("file").alias("path"), (F.col("before") + F.col("i") - F.col("first")).alias("no"), "line")
    full = F.max(F.when(F.col("line") != "", F.col("no")))
    ends = small(lines.groupBy("path").agg(full.alias("end")))
    lines = lines.join(ends, "path").where(F.col("no") <= F.col("end")).drop("end")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.(?:fastq|fq))?$", 1)
    return fastq_records(lines, ("path",)).withColumn("barcode", name).select("barcode", "rec_no", "read_id", "description", "seq", "qual", *["path"] * path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """rec_no (from 0), id, description, seq. Sequences may run over many lines, and a
    record over many splits: each split's headers are counted first, then every
    line knows its record. What stands before the first header is left out."""
    splits = _splits(spark, path).withColumn("head", F.startswith("line", F.lit(">")).cast("int"))
    so_far = F.sum("head").over(Window.partitionBy("file", "at").orderBy("i"))
    lines = splits.withColumn("own", so_far).join(_before(splits, F.sum("head"), "before"), ["file", "at"])
    lines = lines.select((F.col("before") + F.col("own") - 1).alias("rec_no"), "file", "at", "i", "line").where("rec_no >= 0")
    rows = lines.groupBy("rec_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "at", "i", "line"))), lambda x: x["line"]).alias("l"))
    head = F.substring(F.col("l")[0], 2, 1 << 30)
    return rows.select("rec_no", F.split(head, r"\s+")[0].alias("id"), head.alias("description"), F.array_join(F.transform(F.slice("l", 2, F.size("l")), lambda x: F.trim(x)), "").alias("seq"))


def fastq_line() -> Column:
    """The four lines of a record."""
    return F.concat(F.lit("@"), F.coalesce("description", "read_id"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(fastq_line().alias("value"))


def write_fastq(reads: DataFrame, path: str, *, order: str | None = "rec_no", mode: str = "errorifexists") -> None:
    """A folder of FASTQ parts, in the order of a column if one is named."""
    rows = reads.repartitionByRange(order).sortWithinPartitions(order) if order else reads
    fastq_lines(rows).write.mode(mode).text(path)


def write_fasta(reads: DataFrame, path: str, *, key: str = "read_id", width: int | None = 60, order: str | None = "rec_no", mode: str = "errorifexists") -> None:
    """A folder of FASTA parts; sequences wrapped at width, or whole."""
    rows = reads.repartitionByRange(order).sortWithinPartitions(order) if order else reads
    seq = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    rows.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), seq).alias("value")).write.mode(mode).text(path)


def write_cluster_fastq(reads: DataFrame, assigned: DataFrame, path: str, *, key: str = "seq_id", mode: str = "errorifexists") -> None:
    """FASTQ parts of each cluster in a folder of its own, path/cluster=N; noise (-1) is left out."""
    rows = reads.join(assigned.where("cluster >= 0").select(key, "cluster"), key)
    rows.select("cluster", fastq_line().alias("value")).write.mode(mode).partitionBy("cluster").text(path)


def seeded_quality(reads: DataFrame, *, low: int = 20, high: int = 40, seed: int = 42, key: str = "seq_id") -> DataFrame:
    """Reads with a quality string of numbers between low and high that depend on read,
    place and seed."""
    one = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.char(F.lit(33 + low) + F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(high - low + 1))))
    return reads.withColumn("qual", F.when(F.length("seq") > 0, F.array_join(one, "")).otherwise(F.lit("")))


def empty_reads(spark: SparkSession, schema: T.StructType = READ) -> DataFrame:
    return spark.createDataFrame([], schema)


__all__ = ["FASTA", "READ", "empty_reads", "fastq_line", "fastq_lines", "fastq_records", "read_fasta", "read_fastq", "read_fastq_files", "seeded_quality", "write_cluster_fastq", "write_fasta", "write_fastq"]
