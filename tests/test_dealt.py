from pyspark.sql import Window
from pyspark.sql import functions as F

from seqframe import scratch
from seqframe.operators import stats


def test_a_sample_of_reads_ranks_reads_not_rows(spark):
    rows = [(c, k, p) for c in ("a", "b", None) for k in range(40) for p in range(3)] + [("a", None, 1), ("c", 5, 1)]
    table = spark.createDataFrame(rows, "cluster string, seq_id long, position int")
    by = Window.partitionBy("cluster").orderBy(F.xxhash64("seq_id", F.lit(42)), "seq_id")
    want = table.withColumn("n", F.dense_rank().over(by)).where("n <= 7").drop("n")
    got = stats.sample_per_cluster(table, 7)
    key = lambda r: [str(v) for v in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan and "__s" in plan


def test_partitions_follow_the_rows(spark):
    table = spark.range(1000)
    assert scratch.dealt(table, "id", most=100).rdd.getNumPartitions() == 10
    assert scratch.dealt(table, "id", most=100).count() == scratch.dealt(table, "id").count() == 1000
