"""Queries without SQL do the whole job."""

import numpy as np
from pyspark.sql import functions as F

from seqframe import catalog
from seqframe.operators import layout

SF = "/root/testdata/sf0.001"


def test_boxes_reach_the_last_match(spark):
    last = catalog.matches_of(spark, SF).agg(F.max("position")).first()[0]
    got = catalog.QUERIES["box_walk"](spark, SF).agg(F.max(F.col("start") + F.col("length"))).first()[0]
    assert last > 400 and got >= last


def test_boxes_are_walked_without_cells(spark):
    rng = np.random.default_rng(3)
    kind = "seq_id long, position int, length int, query_idx int"
    rows = [(int(r), int(p), int(n), int(q)) for r, p, n, q in zip(rng.integers(0, 40, 3_000), rng.integers(0, 600, 3_000), rng.choice([0, 1, 3, 4, 9, 80], 3_000), rng.permutation(3_000))]
    some = spark.createDataFrame(rows, kind)
    for order in (["position", "query_idx"], ["query_idx"]):
        want = layout.walked_boxes(layout.raster(some, None, order=order)).collect()
        got = layout.walked_matches(some, order=order)
        assert got.columns == ["seq_id", "start", "query_idx", "length"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    far = spark.createDataFrame([(1, 0, 2_000_000_000, 0), (1, 5, 3, 1)], kind)  # a match whose cells can't be listed
    assert [tuple(r) for r in layout.walked_matches(far, order=["position"]).collect()] == [(1, 0, 0, 2_000_000_000)]
    assert layout.walked_matches(far.limit(0), order=["position"]).count() == 0


def test_the_query_walks_no_cells(spark):
    want = layout.walked_boxes(layout.raster(catalog._clustered(spark, SF), None, order=["position", "query_idx"])).collect()
    got = catalog.QUERIES["box_walk"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and "sequence(" not in got._jdf.queryExecution().toString()


def test_every_read_is_aligned(spark):
    reads = catalog.reads_of(spark, SF)
    got = catalog.QUERIES["primer_alignment"](spark, SF)
    assert got.select("seq_id").distinct().count() == reads.count() and got.count() == 2 * reads.count()


def test_word_vectors_have_the_references_size(spark):
    assert len(catalog.QUERIES["word2vec_tokens"](spark, SF).first().features) == 64


def test_every_read_has_its_stand_in(spark):
    got = catalog.QUERIES["compressed_reads"](spark, SF).collect()
    reads = catalog.matches_of(spark, SF).select("seq_id").distinct().count()
    assert sum(r.n_reads for r in got) == reads and len(got) == len({r.cluster for r in got}) == min(reads, 100)
    few = catalog.cluster.compress_reads(catalog.stats.features(catalog.matches_of(spark, SF), catalog.NAMES), 10_000).collect()
    assert {r.n_reads for r in few} == {1} and sorted(r.cluster for r in few) == list(range(reads))


def test_clusters_as_fastq(spark, tmp_path):
    from seqframe.sources import fastq

    reads = catalog._numbered_reads(spark, SF)
    assigned = reads.select("seq_id", (F.col("seq_id") % 3 - 1).cast("int").alias("cluster"))
    fastq.write_cluster_fastq(reads, assigned, str(tmp_path / "c"))
    for k in (0, 1):
        back = fastq.read_fastq(spark, str(tmp_path / "c" / f"cluster={k}"))
        assert sorted(r.read_id for r in back.collect()) == sorted(r.read_id for r in reads.where(f"seq_id % 3 = {k + 1}").collect())


def test_vectors_are_clustered_themselves(spark, monkeypatch):
    seen = []
    tiered = catalog.cluster.ward_tiered
    monkeypatch.setattr(catalog.cluster, "ward_tiered", lambda table, *a, **k: seen.append(table.count()) or tiered(table, *a, **k))
    n = catalog.QUERIES["ward_pipeline"](spark, SF).count()
    assert seen == [n]
