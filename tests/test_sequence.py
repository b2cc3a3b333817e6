import numpy as np
from pyspark.sql import functions as F

from seqframe.functions import sequence as S
from seqframe.schema import parse_primers, queries_df, with_reverse


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_reverse_complement(spark):
    assert column(spark, [("ACGTN*a",), ("",)], "s string", S.reverse_complement("s")) == ["a*NACGT", ""]
    assert column(spark, [("ACGTRn",)], "s string", S.iupac_reverse_complement("s")) == ["nYACGT"]


def test_budget_in_doubles(spark):
    got = column(spark, [("A" * n,) for n in (10, 15, 20, 26, 30)], "s string", S.edit_budget("s", 0.9))
    assert got == [int(n * (1 - 0.9)) for n in (10, 15, 20, 26, 30)] == [0, 1, 1, 2, 2]
    assert column(spark, [("A" * 10,)], "s string", S.exact_edit_budget("s", 0.9)) == [1]


def test_kmers_and_occurrences(spark):
    assert column(spark, [("ACGTA",), ("AC",), ("",)], "s string", S.kmers("s", 3)) == [["ACG", "CGT", "GTA"], [], []]
    rows = [("TTTTTTT", "TTTT"), ("ACGT", "ACGT"), ("xACxAC", "AC"), ("ACG", "ACGT"), ("a.b.*", "."), ("ab" * 300, "ab")]
    got = column(spark, rows, "s string, q string", S.occurrences("s", F.col("q")))
    assert got == [[i for i in range(len(s)) if s.startswith(q, i)] for s, q in rows]


def test_wildcard(spark):
    rows = [("ACGT", "A*GT"), ("ACGT", "TTTT"), ("**", "AC"), ("A*", "AC")]
    assert column(spark, rows, "a string, b string", S.wildcard_similarity("a", "b")) == [1.0, 0.25, 0.0, 1.0]


def test_encoding_matches_numpy(spark):
    got = column(spark, [(7,)], "p int", S.positional_encoding("p", 10))[0]
    want = [np.sin(7 / 10000 ** (i / 10)) if i % 2 == 0 else np.cos(7 / 10000 ** ((i - 1) / 10)) for i in range(10)]
    np.testing.assert_allclose(got, want)


def test_small_helpers(spark):
    assert column(spark, [([1, 2],), ([1, 2, 3, 4],)], "a array<int>", S.padded("a", 3)) == [[1, 2, 0], [1, 2, 3]]
    assert column(spark, [(1, 8), (0, 0)], "a int, b int", S.percent(F.col("a"), F.col("b"))) == [12.5, None]
    assert column(spark, [("ABC!",)], "q string", S.phred("q")) == [[32, 33, 34, 0]]
    assert column(spark, [("a_long_name",)], "q string", S.short_label("q")) == ["...ong_name"]


def test_query_sets(spark):
    assert with_reverse({"L": "AACG"}) == {"L": "AACG", "RCL": "CGTT"}
    assert parse_primers(["P=acgr"]) == {"P": "ACGR", "RC_P": "YCGT"}
    assert [tuple(r) for r in queries_df(spark, {"b": "AC", "a": "GT"}).orderBy("query_idx").collect()] == [(0, "b", "AC"), (1, "a", "GT")]


def test_strings_of_different_lengths_have_nothing_in_common(spark):
    rows = [("ACG", "ACGT"), ("ACG", "ACT"), ("A*G", "ATG"), ("", ""), ("**", "AC"), (None, "A")]
    got = column(spark, rows, "a string, b string", S.wildcard_similarity("a", "b"))
    assert [round(x, 9) for x in got] == [0.0, round(2 / 3, 9), 1.0, 0.0, 0.0, 0.0]
