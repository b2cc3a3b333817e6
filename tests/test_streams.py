import datetime as dt

import pytest

from seqframe.streaming import matches as streaming

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    for k, v in streaming.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in streaming.STATE_STORE:
        spark.conf.unset(k)


def streamed(spark, path, batches, **options):
    schema = "seq_id long, query_name string, position int, ts timestamp"
    for k, rows in enumerate(batches):
        table = spark.createDataFrame([(i, n, p, T0 + dt.timedelta(minutes=m)) for i, n, p, m in rows], schema)
        table.coalesce(1).write.parquet(f"{path}/in/p={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/in/*")
    out = streaming.expiring_reads(stream, **options)
    q = out.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())


def test_ended_unended_and_late_reads(spark, tmp_path, store):
    batches = [
        [(1, "y", 9, 0), (1, "x", 2, 1), (2, "a", 1, 0), (3, "c", 1, 0)],
        [(1, "<end>", 99, 2), (3, "d", 5, 30)],  # 1 ends
        [(4, "z", 1, 500)],  # event time goes on: 2 and 3 never end
        [(2, "late", 7, 3), (4, "<end>", 2, 501), (5, "w", 1, 502)],  # a row behind the watermark is dropped; 5 still waits
    ]
    got = streamed(spark, tmp_path, batches, wait=3600, late="10 minutes")
    assert got == [(1, 2, "x,y", True), (2, 1, "a", False), (3, 2, "c,d", False), (4, 1, "z", True)]


def test_a_gap_ends_a_read_within_a_batch(spark, tmp_path, store):
    got = streamed(spark, tmp_path, [[(1, "a", 1, 0), (1, "b", 2, 30), (1, "c", 3, 200), (1, "<end>", 4, 201), (1, "d", 5, 202), (9, "q", 1, 900)]], wait=3600)
    assert got == [(1, 1, "c", True), (1, 1, "d", False), (1, 2, "a,b", False)]
