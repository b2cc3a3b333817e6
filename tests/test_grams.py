import random
from collections import Counter

import pyarrow as pa

from seqframe import catalog
from seqframe.functions import grams
from seqframe.functions import sequence as S
from seqframe.operators import embed, search

WORDS = ["ACGTACG", "", None, "AC", "ACG", "ÄCGÄ\U0001f600CG", "A" * 50, "acgN-ACG"]


def plain(seq, k):
    return [seq[i : i + k] for i in range(len(seq or "") - k + 1)]


def test_counts_and_lists_equal_plain_ones():
    rng = random.Random(4)
    for words in (WORDS, [w for w in WORDS if w is None or w.isascii()], [], [None], ["".join(rng.choices("ACGT", k=60)) for _ in range(40)]):
        for k in (1, 3, 5, 40):
            column = pa.array(words, pa.string())
            got = list(zip(*map(list, grams.counted(column, k)), strict=True))
            want = {(i, w): n for i, s in enumerate(words) for w, n in Counter(plain(s, k)).items()}
            assert {(int(i), w): int(n) for i, w, n in got} == want and len(got) == len(want)
            whole = grams.counted(column, k, whole=True)
            assert dict(zip(whole[1], map(int, whole[2]), strict=True)) == Counter(w for s in words for w in plain(s, k))
            assert grams.spelled(column, k).to_pylist() == [plain(s, k) for s in words]


def test_queries_count_without_a_row_to_each_place(spark):
    reads = spark.createDataFrame(list(enumerate(WORDS)), "seq_id long, seq string")
    got = {(r.seq_id, r.kmer): r.share for r in embed.kmer_shares(reads, 3).collect()}
    assert got == {(i, w): n / len(plain(s, 3)) for i, s in enumerate(WORDS) for w, n in Counter(plain(s, 3)).items()}
    sums = {r.seq_id: round(sum(r.features), 9) for r in embed.kmer_frequencies(reads, 3).collect()}
    assert sums == {i: float(bool(plain(s, 3))) for i, s in enumerate(WORDS)}
    for name in ("kmer_counts", "kmer_shares", "wildcard_scan"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Generate" not in plan and "regexp_replace" not in plan


def test_wildcards_equal_the_similarity_of_each_window(spark):
    reads = spark.createDataFrame(list(enumerate([*WORDS, "A*GTAC*T*"])), "seq_id long, seq string")
    motifs = {"a": "A*G", "b": "C", "c": "ÄC*Ä", "d": "**", "e": ""}
    for threshold in (0.0, 0.5, 1.0):
        want = set()
        for name, q in motifs.items():
            rows = [(r.seq_id, i, w, q) for r in reads.collect() for i, w in enumerate(plain(r.seq, len(q)) if q else [])]
            scored = spark.createDataFrame(rows, "id long, i int, w string, q string").select("id", "i", S.wildcard_similarity("w", "q").alias("s")).collect() if rows else []
            want |= {(r.id, name, r.i, len(q), r.s) for r in scored if r.s >= threshold}
        assert {tuple(r) for r in search.wildcard_scan(reads, motifs, threshold).collect()} == want


def test_many_tokens_train_in_many_partitions(spark, monkeypatch):
    rows = spark.createDataFrame([(i, ["a", "b", "c"] * 20) for i in range(50)], "seq_id long, tokens array<string>")
    seen, kept = [], embed.Word2Vec
    monkeypatch.setattr(embed, "Word2Vec", lambda **k: seen.append(k["numPartitions"]) or kept(**k))
    for size, parts in ((1 << 20, 1), (300, 10), (10, 128)):
        monkeypatch.setattr(embed, "_TRAINED", size)
        model = embed.word_model(rows, size=4, rounds=1)
        assert seen.pop() == parts and model.getVectors().count() == 3
