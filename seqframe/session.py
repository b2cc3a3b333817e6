"""Session builder with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str | None = None, app: str = "seqframe", **extra: str) -> SparkSession:
    """A session. On a cluster master comes from spark-submit; in local mode the number
    of shuffle partitions follows the cores."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **extra})
    if master:
        builder = builder.master(master)
        cores = master.partition("[")[2].rstrip("]")
        if cores.isdigit():
            builder = builder.config("spark.sql.shuffle.partitions", extra.get("spark.sql.shuffle.partitions", cores))
    return builder.getOrCreate()
