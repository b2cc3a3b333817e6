import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.operators import cluster, embed, layout, motif, stats
from seqframe.plans import pipelines
from seqframe.schema import neighbour_rules, queries_df
from seqframe.sources import fastq, tables
from seqframe.streaming import matches as streaming


def with_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.fixture(autouse=True)
def usual_splits(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_round_trip(spark, tmp_path):
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@r{i} note {i}\nACGT{'A' * i}\n+\n@III{'#' * i}\n" for i in range(25)))
    for size in ("128m", "64"):
        with_splits(spark, size)
        reads = fastq.read_fastq(spark, str(path)).orderBy("rec_no").collect()
        assert [(r.rec_no, r.read_id, r.description, r.seq, r.qual) for r in reads] == [(i, f"r{i}", f"r{i} note {i}", "ACGT" + "A" * i, "@III" + "#" * i) for i in range(25)]
    fastq.write_fastq(fastq.read_fastq(spark, str(path)), str(tmp_path / "out"))
    again = fastq.read_fastq(spark, str(tmp_path / "out"))
    assert sorted(r.read_id for r in again.collect()) == sorted(f"r{i}" for i in range(25))
    many = fastq.read_fastq_files(spark, str(tmp_path / "*.fastq")).collect()
    assert len(many) == 25 and many[0].barcode == "a" and {r.qual[:1] for r in many} == {"@"}


def test_many_files_are_read_by_their_splits(spark, tmp_path):
    """Splits of many files, of which each is numbered by itself, give what whole files give."""
    want = []
    for name, n in (("a", 40), ("b", 3), ("c", 25)):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{name}{i} x\n{'ACGT' * (i + 1)}\n+\n{'@II#' * (i + 1)}\n" for i in range(n)) + "\n" * (n % 2))
        want += [(name, i, f"{name}{i}", f"{name}{i} x", "ACGT" * (i + 1), "@II#" * (i + 1)) for i in range(n)]
    for size in ("128m", "50"):
        with_splits(spark, size)
        assert sorted(tuple(r) for r in fastq.read_fastq_files(spark, str(tmp_path / "*.fq")).collect()) == want
    assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 8
    with_splits(spark, "128m")


def test_broken_fastq_is_an_error(spark, tmp_path):
    (tmp_path / "b.fastq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path / "b.fastq")).collect()


@pytest.mark.parametrize("rest", ["@s\n", "@s\nAC\n", "@s\nAC\n+\n", "@s\nAC\n+\nI\n", "s\nAC\n+\nII\n"])
def test_broken_records_of_many_files(spark, tmp_path, rest):
    """A record that is cut short is an error in both readers; nothing is dropped."""
    (tmp_path / "c.fastq").write_text("@r\nACGT\n+\nIIII\n" + rest)
    for read in (fastq.read_fastq, fastq.read_fastq_files):
        with pytest.raises(Exception, match="not a FASTQ record"):
            read(spark, str(tmp_path / "c.fastq")).collect()
    (tmp_path / "d.fastq").write_text("@r\r\nACGT\r\n+\r\nIIII\r\n\r\n")
    (tmp_path / "e.fastq").write_text("")
    assert [tuple(r) for r in fastq.read_fastq_files(spark, str(tmp_path / "[de].fastq")).collect()] == [("d", 0, "r", "r", "ACGT", "IIII")]


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">a one\nACGT\nAC\n>b\n\n>c\nGG\n")
    for size in ("128m", "7"):
        with_splits(spark, size)
        assert [tuple(r) for r in fastq.read_fasta(spark, str(path)).orderBy("rec_no").collect()] == [(0, "a", "a one", "ACGTAC"), (1, "b", "b", ""), (2, "c", "c", "GG")]
    rows = spark.createDataFrame([(0, "x", "A" * 130)], "rec_no long, read_id string, seq string")
    fastq.write_fasta(rows, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    assert [len(line) for line in text.split()] == [2, 60, 60, 10]
    assert fastq.read_fasta(spark, str(tmp_path / "o")).first().seq == "A" * 130


def test_table_files(spark, tmp_path):
    made = tables.synthetic_matches(spark, 200, ["a", "b"])
    assert made.exceptAll(tables.synthetic_matches(spark, 200, ["a", "b"])).count() == 0
    per = made.groupBy("seq_id").count().agg(F.avg("count"), F.max("count")).first()
    assert 8.5 < per[0] < 11.5 and made.agg(F.min("position"), F.max("length")).first()[1] < 100
    tables.write_matches(made, str(tmp_path / "m"))
    assert tables.read_matches(spark, str(tmp_path / "m")).dtypes == [("seq_id", "string"), ("query_name", "string"), ("position", "int"), ("length", "smallint"), ("score", "float")]
    (tmp_path / "v.txt").write_text("1, 2.5\n\n3,4\n")
    assert [list(r.features) for r in tables.read_vectors(spark, str(tmp_path / "v.txt")).collect()] == [[1.0, 2.5], [3.0, 4.0]]


def test_pixels_spread(spark):
    grid = spark.createDataFrame([(0, 0, 5), (3, 3, 2)], "px int, py int, n long")
    got = {(r.px, r.py): r.n for r in layout.spread(grid, 1).collect()}
    assert got == {**{(x, y): 5 for x in (0, 1) for y in (0, 1)}, **{(x, y): 2 for x in (2, 3, 4) for y in (2, 3, 4)}}


def test_large_clusters_are_dealt(spark, monkeypatch):
    """Farthest points of parts of bounded size; small clusters give what they gave as a whole."""
    table, _ = blobs(spark)
    table = table.withColumn("cluster", F.lit(0)).unionByName(table.select(F.concat(F.lit("q"), "seq_id").alias("seq_id"), "features").withColumn("cluster", F.lit(1)))
    whole = {tuple(r) for r in cluster.compress(table, 10).collect()}
    assert len(whole) == 36
    monkeypatch.setattr(cluster, "MOST", 50)
    parts = cluster.compress(table, 10).groupBy("cluster").count().collect()
    assert all(10 <= r["count"] <= 22 for r in parts) and len(parts) == 2


def blobs(spark, n=60):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "seq_id string, features array<double>"), x


def same_partition(labels, n):
    parts = [set(labels[k * n : (k + 1) * n]) for k in range(3)]
    return all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3


@pytest.mark.parametrize("method", ["kmeans", "hierarchical", "birch", "meanshift", "affinity", "spectral"])
def test_blobs_come_apart(spark, method):
    table, _ = blobs(spark, 20)
    got = {r.seq_id: r.cluster for r in cluster.cluster(table, method, 3).collect()}
    labels = [got[f"p{i:03d}"] for i in range(60)]
    if method in ("kmeans", "hierarchical", "birch"):
        assert same_partition(labels, 20)
    else:  # these may find more clusters, but none that has points of two blobs
        assert all(len({i // 20 for i in range(60) if labels[i] == c}) == 1 for c in set(labels))
    assert len(labels) == 60 and min(labels) >= -1
    with pytest.raises(ValueError):
        cluster.cluster(table, "none of these", 3)


def test_density_methods():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (8, 0), (0, 8))] + [[[30.0, 30.0]]])
    for labels in (cluster.dbscan(x, 0.8, 5), cluster.hdbscan(x, 5, 10), cluster.optics(x, 5)):
        assert labels[-1] == -1 and same_partition(labels.tolist(), 30)


def test_bandwidth_and_preference():
    """With parameters that fit the blobs both methods find just these."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    assert same_partition(cluster.mean_shift(x, 2.0).tolist(), 20)


def test_ward_heights_and_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 3))
    heights = [m[2] for m in cluster.ward_merges(x)]
    assert heights == sorted(heights) and len(heights) == 24
    groups = [[i] for i in range(25)]
    while len(groups) > 4:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    labels = cluster.ward(x, 4)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(4)} == {frozenset(g) for g in groups}


def test_representatives(spark):
    table, x = blobs(spark)
    picked = cluster.farthest_points(x, 9)
    assert len(picked) == 9 and int(np.linalg.norm(x - x.mean(0), axis=1).argmin()) in picked
    labelled = table.join(cluster.kmeans(table, 3)[0], "seq_id")
    assert cluster.compress(labelled, 1000).count() == 180
    assert cluster.compress(labelled, 10).count() == 18
    assert 0.8 < cluster.silhouette(labelled) < 1
    assert cluster.pipeline(table, 3, reduce_to=30).select("cluster").distinct().count() == 3
    near = cluster.nearest_representative(table, table.limit(5)).where("distance = 0").count()
    assert near == 5
    assert [r for r in cluster.compared(table, ["kmeans", "nothing"], 3) if "error" in r][0]["method"] == "nothing"


def test_word_vectors(spark):
    rows = [(f"r{i}", n, 10 * k, 4, 1.0) for i in range(20) for k, n in enumerate(["A", "B", "C"])]
    found = spark.createDataFrame(rows, "seq_id string, query_name string, position int, length int, score double")
    sequences = embed.name_sequences(found)
    model = embed.word_model(sequences, size=4, window=2, least=1, rounds=1)
    extra = sequences.union(spark.createDataFrame([("none", ["Z"]), ("half", ["A", "Z"])], sequences.schema))
    got = {r.seq_id: list(r.features) for r in embed.embed_tokens(extra, model).collect()}
    vectors = {r.word: np.array(r.vector) for r in model.getVectors().collect()}
    np.testing.assert_allclose(got["r0"], np.mean([vectors[n] for n in "ABC"], axis=0), rtol=1e-6)
    np.testing.assert_allclose(got["half"], vectors["A"], rtol=1e-6)
    assert got["none"] == [0.0] * 4
    assert len(embed.embed_positional(found, model).first().features) == 14
    assert len(embed.embed_weighted(found, model).first().features) == 4
    assert embed.projected(found, size=5).exceptAll(embed.projected(found, size=5)).count() == 0


def test_characters(spark):
    reads = spark.createDataFrame([("a", "ACGT"), ("b", "AX")], "seq_id string, seq string")
    ids = embed.encode_chars(reads, {"A": 2, "C": 3, "G": 4, "T": 5}, 3)
    assert {r.seq_id: list(r.ids) for r in ids.collect()} == {"a": [2, 3, 4], "b": [2, 1, 0]}
    assert {r.seq_id: r.seq for r in embed.decode_chars(ids, {"A": 2, "C": 3, "G": 4}).collect()} == {"a": "ACG", "b": "A[UNK]"}
    assert len(embed.char_components(embed.encode_chars(reads, {"A": 2, "C": 3}, 3), 2).first().features) == 2


def test_motif_tree_and_layout(spark):
    seqs = spark.createDataFrame([("AC",), ("AC",), ("AG",), ("AG",), ("TC",)], "seq string")
    assert sorted(r.motif for r in motif.motif_tree(seqs, 2).collect()) == ["AC", "AG"]
    assert motif.consensus_sequence(motif.position_weights(seqs)).first()[0] == "AC"
    found = spark.createDataFrame([("r", "a", 0, 3), ("r", "b", 2, 3)], "seq_id string, query_name string, position int, length int")
    cells = layout.raster(layout.with_query_index(found, queries_df(spark, {"a": "x", "b": "y"})), 10, order=["position"])
    assert [(r.pos, r.query_idx) for r in cells.orderBy("pos").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]
    assert sorted((r.start, r.size) for r in layout.runs(cells).collect()) == [(0, 2), (2, 3)]
    assert sorted((r.start, r.length) for r in layout.walked_boxes(cells).collect()) == [(0, 3), (3, 3)]
    with pytest.raises(ValueError):
        layout.compressed(found, "other")
    grid = spark.createDataFrame([(0, 0, 1), (0, 1, 10)], "px int, py int, n long")
    assert max(r.level for r in layout.shaded(grid).collect()) == 1.0 and layout.shaded(grid, "eq_hist").count() == 2
    assert stats.histogram(found, "position", 2).count() == 2


def test_sql_and_junctions(spark, tmp_path):
    reads = spark.createDataFrame([(0, "a", "a", "GGACGTTTTTGATCACGTGG", "I" * 20)], "rec_no long, read_id string, description string, seq string, qual string")
    queries = {"L": "ACGT", "R": "GATC"}
    found = pipelines.find(reads, queries, "exact", key="read_id")
    pipelines.register(spark, reads=reads, matches=found, queries=queries)
    assert spark.sql("select m.position, m.distance from reads, lateral motif_search(seq, 'GATC', 0) m").collect()[0].position == 10
    assert spark.sql("select count(*) from matches").first()[0] == 3
    rules = neighbour_rules(spark, [{"start": "L", "end": "R", "orientation": "direct"}])
    assert [r.seq for r in pipelines.extract_junctions(reads, queries, rules, 0, 50, str(tmp_path / "j")).collect()] == ["TTTT"]


def test_streams(spark, tmp_path):
    source, rows = tmp_path / "in", tables.synthetic_matches(spark, 30, ["a", "b"])
    rows.repartition(3).write.parquet(str(source))
    q = streaming.counts_to(streaming.match_stream(spark, str(source), files=1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    latest = max((tmp_path / "out").glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))
    got = {r.query_name: r.n for r in spark.read.parquet(str(latest)).collect()}
    assert got == {r.query_name: r["count"] for r in rows.groupBy("query_name").count().collect()}


def test_reads_leave_the_stream_once(spark, tmp_path):
    schema = "seq_id string, query_name string, position int"
    batches = [[("a", "y", 9), ("b", "x", 1)], [("a", "x", 2), ("a", "<end>", 99)], [("b", "<end>", 99), ("c", "z", 0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streaming.whole_reads(stream).writeStream.format("memory").queryName("whole").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert sorted(tuple(r) for r in spark.table("whole").collect()) == [("a", 2, "x,y"), ("b", 1, "x")]


def test_large_samples_equal_the_sorted_ones(spark):
    from seqframe.operators import stats

    rows = spark.range(3000).selectExpr("id % 2900 as k", "id").cache()
    for n in (0, 1, 57, 2950, 2999, 3000, 9999):
        want = [r.k for r in rows.orderBy("k").orderBy(F.xxhash64(F.col("k"), F.lit(42)), "k").limit(n).collect()]
        for most in (1, 20, 10_000):
            got = stats.sample_of(rows, n, key="k", most=most)
            assert sorted(r.k for r in got.collect()) == sorted(want), (n, most)
    assert stats.sample_of(rows.limit(0), 50, key="k", most=1).count() == 0


def test_rows_as_they_are_first_seen(spark):
    rows = spark.createDataFrame([("b", 3), ("a", 9), ("b", 1), ("c", 2), ("a", 4)], "seq_id string, n int")
    assert {r.seq_id: r.row for r in layout.row_index(rows, first="n").collect()} == {"b": 0, "c": 1, "a": 2}


def test_kmer_vectors_are_means_over_all_kmers(spark):
    reads = spark.createDataFrame([(1, "ACGTACGTACGT"), (2, "ACG"), (3, None), (4, "TTTTTTTACGTAC")], "seq_id long, seq string")
    model = embed.word_model(embed.kmer_sequences(reads, 4), size=5, rounds=1, least=1)
    by_counts = {r.seq_id: r.features for r in embed.embed_kmers(reads, model, 4).collect()}
    by_tokens = {r.seq_id: r.features for r in embed.embed_tokens(embed.kmer_sequences(reads, 4), model).collect()}
    assert by_counts.keys() == by_tokens.keys() == {1, 2, 3, 4} and by_counts[2] == by_counts[3] == [0.0] * 5
    for k in by_counts:
        np.testing.assert_allclose(by_counts[k], by_tokens[k], atol=1e-9)
