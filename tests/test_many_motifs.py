import random

from seqframe.operators import search


def test_more_motifs_than_a_block_take_one_pass_to_a_length(spark, monkeypatch):
    rng = random.Random(7)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(0, 90))) for _ in range(60)] + ["", None, "ÄCGTÄCGTÄCGTÄCGT", "ACACACACACACACACAC"]
    reads = spark.createDataFrame([(i, s, f"b{i % 3}") for i, s in enumerate(seqs)], "seq_id long, seq string, barcode string")
    motifs = sorted({s[k : k + m] for s in seqs if s for m in (6, 9) for k in (0, 3) if len(s) >= k + m})
    rows = [(f"m{k}", q, k) for k, q in enumerate(motifs)] + [("twice", motifs[0], -1), ("empty", "", -2), ("none", None, -3)]
    table = spark.createDataFrame(rows, "query_name string, query_seq string, query_idx long")
    want = {(i, n, k, len(q), 1.0, f"b{i % 3}") for i, s in enumerate(seqs) if s for n, q, _ in rows if q for k in range(len(s)) if s.startswith(q, k)}
    monkeypatch.setattr(search, "_BLOCK", 256)
    passes, searched = [], search._searched
    monkeypatch.setattr(search, "_searched", lambda *a: passes.append(1) or searched(*a))
    got = search.exact_matches(reads, table, keep=("barcode",)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len(passes) == 2
