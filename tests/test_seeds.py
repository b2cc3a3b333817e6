import random

import numpy as np
import pytest

from seqframe.operators import search
from seqframe.operators.seeds import Automaton, Budgeted, Text


def cases(seed, n):
    """Reads and motifs, some of which are places of a read with a few edits."""
    rng = random.Random(seed)
    for t in range(n):
        letters = "ACGT" if t % 3 else "ACéλ日"
        seqs = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 90, 200]))) for _ in range(8)]
        motifs, budgets = [], []
        for _ in range(12):
            m = [rng.choice(letters + "X" * (t % 5 == 0)) for _ in range(rng.choice([1, 2, 4, 9, 15, 30, 63, 64, 65, 130]))]
            s = rng.choice(seqs)
            if len(s) > 8 and rng.random() < 0.5:
                a = rng.randrange(len(s) - 4)
                m = list(s[a : a + rng.randint(4, 130)])
                for _ in range(rng.randint(0, 3)):
                    k = rng.randrange(len(m))
                    m[k : k + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
            motifs.append("".join(m) or "A")
            budgets.append(rng.randint(0, 4))
        yield Text(seqs), motifs, budgets


def test_budgeted_search_equals_the_plain_program():
    """Seeds, halves and bit vectors find what a dynamic program over every place finds."""
    for text, motifs, budgets in cases(1, 60):
        got = sorted(zip(*(x.tolist() for x in search._placed(motifs, budgets)(text)), strict=True))
        want = [(k, *r) for k, (m, b) in enumerate(zip(motifs, budgets, strict=True)) for r in zip(*(x.tolist() for x in search.best_places(text, m, b)), strict=True)]
        assert got == sorted(want)


def test_automaton_equals_find():
    for text, motifs, _ in cases(2, 60):
        got = sorted(zip(*(x.tolist() for x in Automaton([*motifs, motifs[0]]).find(text)), strict=True))
        assert got == sorted((k, a) for k, m in enumerate([*motifs, motifs[0]]) for a in text.places(m).tolist())


def test_no_motifs_and_no_reads():
    assert [len(x) for x in search._placed([], [])(Text(["ACGT"]))] == [0] * 5
    assert [len(x) for x in Automaton([]).find(Text(["ACGT"]))] == [0, 0]
    assert [len(x) for x in Budgeted(["ACGTACGT"], [1]).find(Text([]))] == [0] * 5
    assert [len(x) for x in Budgeted(["ACGTACGT"], [1]).find(Text(["", ""]))] == [0] * 5


def test_most_places_are_never_verified():
    rng = np.random.default_rng(0)
    text = Text(["".join(rng.choice(list("ACGT"), 4000)) for _ in range(25)])
    found = Budgeted(["".join(rng.choice(list("ACGT"), 20)) for _ in range(2000)], [1] * 2000)._seeds(text)[0]
    assert len(found) < 2000  # of 2000 motifs at 100,000 places


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_a_table_of_many_motifs(spark, monkeypatch, block):
    """More motifs than one block holds, from a table, spelled alike or not; nulls and empty ones match nothing."""
    monkeypatch.setattr(search, "_BLOCK", block)
    rng = random.Random(3)
    n = 12_000 if block > 100 else 40
    motifs = ["".join(rng.choices("ACGT", k=rng.randint(8, 12))) for _ in range(n)]
    rows = [(f"m{i}", m, i) for i, m in enumerate(motifs)] + [("again", motifs[0], n), ("empty", "", n + 1), ("none", None, n + 2)]
    queries = spark.createDataFrame(rows, "query_name string, query_seq string, query_idx long")
    reads = [(i, "".join(rng.choices("ACGT", k=30)) + motifs[i] + "T") for i in range(30)] + [(98, None), (99, "")]
    table = spark.createDataFrame(reads, "seq_id long, seq string")
    got = sorted((r.seq_id, r.query_name, r.position) for r in search.exact_matches(table, queries).collect())
    want = sorted((i, name, a) for i, s in reads if s for name, m, _ in rows if m for a in range(len(s)) if s.startswith(m, a))
    assert got == want and {(i, f"m{i}") for i in range(30)} <= {g[:2] for g in got}
    some = queries.where("query_idx < 40 or query_idx >= %d" % n)
    got = sorted(tuple(r) for r in search.edit_matches(table, some, 0.9).collect())
    one = [search.edit_matches(table, {name: m}, 0.9) for name, m, i in rows if m and (i < 4 or i == n)]
    want = {tuple(r) for part in one for r in part.collect()}
    assert want == {g for g in got if g[1] in {"m0", "m1", "m2", "m3", "again"}} and {(i, f"m{i}") for i in range(30)} <= {g[:2] for g in got}
