import random
from collections import Counter

import pytest

from seqframe.operators import motif, search
from seqframe.operators.localalign import aligned
from seqframe.operators.seeds import Text


def tree(seqs, depth, threshold):
    """By recursion over the sequences themselves."""
    def below(some, k):
        if k == depth:
            return {some[0][:depth]: len(some)} if some else {}
        n = Counter(s[k] for s in some if s[k] in "ACGT")
        out = {}
        for base, c in n.items():
            if c >= (1 - threshold) * max(n.values()):
                out |= below([s for s in some if s[k] == base], k + 1)
        return out

    return below([s for s in seqs if len(s) >= depth], 0)


@pytest.mark.parametrize(("depth", "threshold"), [(1, 0.5), (6, 0.4), (7, 0.6), (20, 0.6)])
def test_tree_equals_recursion(spark, depth, threshold):
    rng = random.Random(depth)
    roots = ["".join(rng.choices("ACGT", k=25)) for _ in range(3)]
    seqs = ["".join(c if rng.random() < 0.9 else rng.choice("ACGTN") for c in rng.choice(roots))[: rng.randint(5, 25)] for _ in range(300)] + ["", "NNNNNNNNNNNNNNNNNNNNNNNNN"]
    got = {r.motif: r.n for r in motif.motif_tree(spark.createDataFrame([(s,) for s in seqs], "seq string"), depth, threshold).collect()}
    assert got == tree(seqs, depth, threshold)


def test_a_deep_tree(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choices("ACGT", k=200)) for _ in range(2))
    table = spark.createDataFrame([(a,)] * 10 + [(a[:199] + "N",)] + [(b,)] * 10, "seq string")
    got = {r.motif: r.n for r in motif.motif_tree(table, 200).collect()}
    assert got == {a: 10, b: 10} or a[0] == b[0]
    assert motif.motif_tree(table.limit(0), 200).count() == 0


def test_windows(spark):
    reads = spark.createDataFrame([(1, "AAAAC"), (2, "GAAT"), (3, None), (4, ""), (5, "AA")], "id long, seq string")
    assert sorted((r.id, r.seq) for r in motif.windows(reads, "AA", 3, keep=("id",)).collect()) == [(1, "AAA"), (1, "AAA"), (1, "AAC"), (2, "AAT")]
    with pytest.raises(ValueError):
        motif.windows(reads, "AAAA", 3)


def one_by_one(a, b):
    """Score, and the earliest end in b then in a, of the best local alignment."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (a[i - 1] == b[j - 1]), h[i - 1][j] - 1, h[i][j - 1] - 1)
    best = max(map(max, h))
    return best, min((j, i) for i, row in enumerate(h) for j, v in enumerate(row) if v == best) if best else (0, 0)


def test_many_reads_are_aligned_like_each_alone():
    rng = random.Random(4)
    for t in range(40):
        letters = "ACGTé" if t % 5 == 0 else "ACGT"
        seqs = ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 10, 40, 120]))) for _ in range(12)]
        m = "".join(rng.choices("ACGT", k=rng.choice([1, 2, 5, 12, 30, 150])))
        for s, (score, blocks, equal) in zip(seqs, aligned(Text(seqs), m), strict=True):
            best, (j, i) = one_by_one(m, s)
            assert score == best and (not best or (blocks[-1][3], blocks[-1][1]) == (j, i))
            gaps = sum(y[0] - x[1] + y[2] - x[3] for x, y in zip(blocks, blocks[1:], strict=False))
            assert equal - gaps == score and equal == sum(m[k] == s[c + k - a] for a, b, c, _ in blocks for k in range(a, b))
    assert aligned(Text([]), "ACGT") == [] and aligned(Text(["ACGT"]), "") == [(0, [], 0)]


def test_drawing_is_only_made_on_request(spark):
    reads = spark.createDataFrame([(1, "GGACGTACGTGG")], "seq_id long, seq string")
    assert search.local_alignments(reads, {"p": "ACGTACGT"}).first().drawing is None
    assert search.local_alignments(reads, {"p": "ACGTACGT"}, drawing=True).first().drawing == "ACGTACGT\n||||||||\nACGTACGT"
