import random

import numpy as np
import pytest

from seqframe.functions.sequence import complement_of
from seqframe.operators import search


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(seq, motif, k):
    found = [(levenshtein(seq[a:b], motif), b, a) for a in range(len(seq) + 1) for b in range(a, len(seq) + 1) if abs(b - a - len(motif)) <= k]
    best = min((d for d, _, _ in found), default=k + 1)
    if best > k:
        return []
    first = {}
    for d, b, a in sorted(found):
        if d == best:
            first[b] = min(first.get(b, a), a)
    return [(a, b, best) for b, a in sorted(first.items())]


def test_edit_search_equals_all_substrings():
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for motif, k in (("ACGTAC", 1), ("GATTACAGA", 2), ("ACG", 0)):
        assert search.best_locations(seqs, motif, k) == [brute(s, motif, k) for s in seqs]


def test_planted_motif_is_found(spark):
    motif = "ACGTTGCAACGGTCA"
    reads = spark.createDataFrame([("r1", "TTTT" + motif[:7] + "T" + motif[8:] + "GGGG"), ("r2", "A" * 50), ("r3", None), ("r4", "ACG")], "seq_id string, seq string")
    got = search.edit_matches(reads, {"m": motif}, 0.9).collect()
    assert [(r.seq_id, r.position, r.length) for r in got] == [("r1", 4, 15)] and got[0].score == pytest.approx(1 - 1 / 15)
    assert search.edit_matches(reads, {"m": motif}, 0.9, length_mode="reference").first().length == 14
    turned = reads.replace({r.seq: complement_of(r.seq) for r in reads.collect() if r.seq}, subset=["seq"])
    assert [r.score for r in search.edit_matches(turned, {"m": complement_of(motif)}, 0.9).collect()] == [got[0].score]


def test_exact_search(spark):
    reads = spark.createDataFrame([("a", "TTTTTTT"), ("b", ""), ("c", None), ("d", "TTT")], "seq_id string, seq string")
    assert sorted(r.position for r in search.exact_matches(reads, {"t": "TTTT"}).collect()) == [0, 1, 2, 3]


def test_matches_end_with_their_read(spark):
    """Neither search goes over from a read to the next one; columns are taken along."""
    reads = spark.createDataFrame([("a", "GGAC", "x"), ("b", "GTGG", None), ("c", "ACGT", "y"), ("d", "éACGTé", "z")], "seq_id string, seq string, query_name string").coalesce(1)
    got = search.exact_matches(reads.withColumnRenamed("query_name", "tag"), {"m": "ACGT", "none": "", "e": "é"}, keep=("tag",)).collect()
    assert sorted((r.seq_id, r.query_name, r.position, r.tag) for r in got) == [("c", "m", 0, "y"), ("d", "e", 0, "z"), ("d", "e", 5, "z"), ("d", "m", 1, "z")]
    assert search.best_locations(["GGAC", "GTGG", "GAC"], "ACGT", 1) == [[], [], []]
    assert search.best_locations(["GGACG", "CGTGG"], "ACGT", 1) == [[(2, 5, 1)], [(0, 3, 1)]]


def test_peaks():
    assert search.peaks(np.array([0.8, 0.8, 0.7, 0.6])) == []  # a plateau at the edge is none
    assert search.peaks(np.array([0, 1, 1, 1, 0, 2, 0.0])) == [2, 5]
    assert search.peaks(np.array([0, 1, 0, 2, 0.0]), apart=3) == [3]
    assert search.peaks(np.array([0, 1, 0, 0, 1, 2, 3, 2, 1, 0.0]), width=2) == [6]
    assert search.fragment_peaks(np.array([0, 1, 2, 9, 10]), np.array([0.9, 1, 1, 0.9, 0.9]), 4) == [1, 3]


def test_window_search(spark):
    reads = spark.createDataFrame([("a", "GGGGACGTACGTGGGG")], "seq_id string, seq string")
    got = [(r.position, r.score) for r in search.window_matches(reads, {"m": "ACGTACGT"}, 0.9).collect()]
    assert got == [(4, 1.0)]
    with pytest.raises(ValueError):
        search.window_matches(reads, {"m": "A"}, pick="other")


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (a[i - 1] == b[j - 1]), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_local_alignment():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 15))) for _ in range(2))
        score, blocks, equal = search.align_local(a, b)
        assert score == smith_waterman(a, b) == search.align_local(b, a)[0]
        gaps = sum(y[0] - x[1] + y[2] - x[3] for x, y in zip(blocks, blocks[1:]))
        assert equal - gaps == score and all(x[1] - x[0] == x[3] - x[2] for x in blocks)


def test_reports(spark):
    reads = spark.createDataFrame([("a", "GGACGTACGTGG"), ("b", "TTTTTTTT"), ("c", "")], "seq_id string, seq string")
    aligned = search.local_alignments(reads, {"p": "ACGTACGT"})
    marked = {r.seq_id: r.marked for r in aligned.collect()}
    assert marked["a"] == "GG<p>ACGTACGT</p>GG" and marked["c"] == ""
    assert tuple(search.primer_summary(aligned).first()) == (3, 1, 33.3)
    assert tuple(search.primer_summary(aligned.limit(0)).first()) == (0, 0, None)
    report = {r.seq_id: r for r in search.primer_report(aligned).collect()}
    assert list(report["a"].detected) == ["p"] and not report["b"].detected
