import pytest

from seqframe.operators import pairs
from seqframe.schema import neighbour_rules, primer_rules

M = "seq_id string, query_name string, position int, length int, score double"


@pytest.fixture(scope="module")
def matches(spark):
    rows = [("r1", "A", 0, 4, 1.0), ("r1", "B", 10, 4, 1.0), ("r1", "A", 12, 4, 1.0), ("r1", "B", 30, 4, 1.0), ("r2", "A", 0, 4, 1.0), ("r2", "B", 5, 4, 1.0), ("r3", "Barcode1", 3, 4, 1.0)]
    return spark.createDataFrame(rows, M)


def test_distances(matches):
    got = [(r.seq_id, r.query_name, r.next_name, r.gap, r.abs_gap, r.start_delta) for r in pairs.adjacent(matches).orderBy("seq_id", "position").collect()]
    assert got == [("r1", "A", "B", 6, 6, 10), ("r1", "B", "A", -2, 2, 2), ("r1", "A", "B", 14, 14, 18), ("r2", "A", "B", 1, 1, 5)]


def test_two_matches_are_too_few_for_rules(spark, matches):
    rules = neighbour_rules(spark, [{"start": "A", "end": "B", "orientation": "direct"}])
    inner = sorted(tuple(r)[:3] for r in pairs.junctions(matches, rules, 0, 100).collect())
    assert inner == [("r1", 4, 10), ("r1", 16, 30)]
    assert len(pairs.junctions(matches, rules, 0, 100, min_matches=2).collect()) == 3
    outer = sorted(tuple(r)[:3] for r in pairs.junctions(matches, rules, 0, 10, include=True).collect())
    assert outer == [("r1", 0, 14)]


def test_windows_gaps_and_sets(spark, matches):
    rules = primer_rules(spark, [{"primer": "B", "distance_max": 7}])
    assert sorted(tuple(r)[1:3] for r in pairs.primer_windows(matches, rules).collect()) == [(14, 21), (34, 41)]
    assert sorted(r.position for r in pairs.gap_filter(matches, 6).where("seq_id = 'r1'").collect()) == [0, 10, 12, 30]
    assert sorted(r.seq_id for r in pairs.reads_with_all(matches, ["A", "B"], ["Barcode1"]).collect()) == ["r1", "r2", "r3"]
    assert pairs.without_barcodes(matches).count() == 6 and pairs.without_barcodes(matches, "barcode").count() == 7


def test_trimming(spark):
    reads = spark.createDataFrame([(0, "a", "a", "ACGTTTGA", "12345678")], "rec_no long, read_id string, description string, seq string, qual string")
    regions = spark.createDataFrame([(0, 1, 5, "direct"), (0, 2, 6, "reverse"), (0, 6, 12, "direct")], "rec_no long, start_pos int, end_pos int, orientation string")
    got = [(r.read_id, r.seq, r.qual) for r in pairs.trimmed(reads, regions, key="rec_no").orderBy("start_pos").collect()]
    assert got == [("1", "CGTT", "2345"), ("2", "AAAC", "6543")]
    kept = pairs.trimmed(reads, regions, key="rec_no", drop_short=False, quality_mode="reference").orderBy("start_pos").collect()
    assert [(r.seq, r.qual) for r in kept] == [("CGTT", "2345"), ("AAAC", "3456"), ("GA", "78")]


def test_selected_reads(spark):
    reads = spark.createDataFrame([(0, "a", "a", "AACG", "1234")], "rec_no long, read_id string, description string, seq string, qual string")
    ids = reads.select("rec_no")
    assert sorted((r.read_id, r.seq, r.qual) for r in pairs.selected_reads(reads, ids, ids).collect()) == [("a", "AACG", "1234"), ("a_RC", "CGTT", "4321")]
