"""Tables in and out: matches, embeddings, cluster results, vectors as text, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.schema import MATCH, MATCH_ORDINAL


def as_matches(rows: DataFrame, *, ordinal: bool = False) -> DataFrame:
    """Cast to the match schema; extra columns are dropped."""
    schema = MATCH_ORDINAL if ordinal else MATCH
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_matches(rows: DataFrame, path: str, *, mode: str = "errorifexists", ordinal: bool = False) -> None:
    as_matches(rows, ordinal=ordinal).write.mode(mode).option("compression", "zstd").parquet(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_embeddings(rows: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("compression", "zstd").parquet(path)


def write_clusters(rows: DataFrame, path: str, *, key: str = "seq_id", mode: str = "errorifexists") -> None:
    """path/parquet with all columns, path/csv with key and cluster."""
    rows.write.mode(mode).option("compression", "snappy").parquet(f"{path}/parquet")
    rows.select(key, "cluster").write.mode(mode).option("header", "true").csv(f"{path}/csv")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def write_csv(rows: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", "true").csv(path)


def write_report(rows: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """JSON lines."""
    rows.write.mode(mode).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """features: one comma-separated vector to a line."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.transform(F.split("value", ","), lambda x: F.trim(x).cast("float")).alias("features"))


def wide(rows: DataFrame, size: int, *, key: str = "seq_id") -> DataFrame:
    """features as columns e0, e1, ..."""
    return rows.select(key, *[F.col("features")[k].alias(f"e{k}") for k in range(size)])


def narrow(rows: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """All columns but the key as one features array of doubles."""
    return rows.select(key, F.array(*[F.col(c).cast("double") for c in rows.columns if c != key]).alias("features"))


def synthetic_matches(spark: SparkSession, reads: int, motifs: list[str], *, mean: float = 10.0, seed: int = 42) -> DataFrame:
    """Matches that depend on the seed only: a Poisson number to a read (by inversion of
    a hash), motifs at random, positions in [0, 10000), lengths in [10, 100)."""

    def unit(*of):
        return (F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    below = F.lit(2.718281828459045) ** (-mean)
    chance, total, n = below, below, F.lit(0)
    u = unit(F.col("id"), F.lit("n"))
    for k in range(1, int(mean + 8 * mean**0.5) + 1):
        n = F.when(u > total, F.lit(k)).otherwise(n)
        chance = chance * (mean / k)
        total = total + chance
    rows = spark.range(reads).withColumn("n", n).where("n > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    name = F.element_at(F.array(*map(F.lit, motifs)), (F.floor(unit("id", "k", F.lit("m")) * len(motifs)) + 1).cast("int"))
    return rows.select(
        F.concat(F.lit("read_"), F.col("id").cast("string")).alias("seq_id"),
        name.alias("query_name"),
        F.floor(unit("id", "k", F.lit("p")) * 10_000).cast("int").alias("position"),
        (F.floor(unit("id", "k", F.lit("l")) * 90) + 10).cast("smallint").alias("length"),
        F.lit(1.0).cast("float").alias("score"),
    )
