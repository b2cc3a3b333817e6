"""Connected components of an edge table, with label propagation and pointer jumping.

Each round gives a node the smallest label among its neighbours and itself, then the
label of that label. Tables of a round are written to the shared folder and replace
those of the round before. Edges are joined as they come: a node's number of edges
should be bounded by its source, while a label may be as popular as it likes, for such
joins have one row to a label on the other side and are split when they are skewed. They
merge by a hint: compressed files would let Spark broadcast tables many times their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut, drop, has_rows


def connected(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Columns: node, component (the smallest node that can be reached). Edges are
    undirected; repeated edges and loops do no harm; nulls take no part. No edges: no rows."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(u).alias("node"), F.col(v).alias("near")).where("node <> near")
    both, kept = cut(pairs.union(pairs.select("near", "node")).distinct())
    now, at = cut(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        told = both.join(now.hint("merge"), "node").groupBy(F.col("near").alias("node")).agg(F.min("component").alias("m"))
        told, told_at = cut(told)
        lower, lower_at = cut(now.join(told.hint("merge"), "node").select("node", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved")))
        root = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped, jumped_at = cut(lower.join(root.hint("merge"), "component").select("node", F.col("root").alias("component"), (F.col("moved") | (F.col("root") < F.col("component"))).alias("moved")))
        moved = has_rows(jumped.where("moved"))
        for path in (at, told_at, lower_at):
            drop(spark, path)
        now, at = jumped.select("node", "component"), jumped_at
        if not moved:
            drop(spark, kept)
            return now
