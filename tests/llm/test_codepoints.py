import math
from collections import Counter

import pytest

from seqframe.llm import codepoints, perplexity


def test_scripts_other_than_latin(spark):
    line = "Съешь ещё этих мягких французских булок, да выпей чаю в 1984 году. "
    mixed = "".join(sorted(line * 3, key=lambda c: (ord(c) * 7919) % 101))
    rows = [(i, line * 3, "ru") for i in range(20)] + [(50, line * 3, "ru"), (51, mixed, "ru"), (52, line.replace("1984", "7777") * 3, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.classify(docs, docs.where("doc_id < 20")).collect()}
    assert got[50].keep and not got[51].keep and got[51].perplexity > 10 * got[50].perplexity
    assert got[52].perplexity > 1.01 * got[50].perplexity


def by_hand(trusted, text):
    """The same model in plain Python."""
    n = codepoints.ORDER
    grams = lambda t: [("   " + t.lower())[i : i + n] for i in range(len(t.lower()))]
    tables = [Counter(g for t in trusted for g in grams(t))]
    for _ in range(n - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    cuts = []
    for table in tables:
        n1, n2, n3, n4 = (sum(c == k for c in table.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
        found = [m - (m + 1) * y * b / a if a else 0.5 for m, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        cuts.append([0] + [d if d > 0 else 0.5 for d in found])

    def p(g, k=0):
        if not g:
            return 1 / 0x110000
        own = {h: c for h, c in tables[k].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:], k + 1)
        d = cuts[k]
        back = sum(d[min(c, 3)] for c in own.values())
        c = own.get(g, 0)
        return (max(c - d[min(c, 3)], 0) + back * p(g[1:], k + 1)) / sum(own.values())

    return math.exp(-sum(math.log(p(g)) for g in grams(text)) / len(text.lower()))


@pytest.mark.parametrize("block", [1 << 21, 7])
def test_against_plain_python(spark, monkeypatch, block):
    texts = ["Der Hund und der Kater", "на дворе трава, на траве дрова", "😀日本語の本、日本の語", "", "unseen ž words \0 here", "der und"]
    if block < 100:
        monkeypatch.setattr(codepoints, "BLOCK", block)
        packed = [list(codepoints.pieces(t)) for t in texts]
        assert [sum(len(s) - 3 for s in p) for p in packed] == [len(t.lower()) for t in texts]
        for t, p in zip(texts, packed, strict=True):
            if p:
                grams, counts = codepoints.tally(p)
                assert dict(zip(grams, counts.tolist(), strict=True)) == Counter(("   " + t.lower())[i : i + 4] for i in range(len(t.lower())))
        return
    rows = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "id long, lang string, text string")
    counts = codepoints.count_grams(rows.where("id < 3"))
    got = {r.id: r.perplexity for r in codepoints.perplexities(rows.repartition(2), counts).collect()}
    assert len(got) == len(texts) and got[3] is None
    for i, t in enumerate(texts):
        if t:
            assert got[i] == pytest.approx(by_hand(texts[:3], t), rel=1e-9)
