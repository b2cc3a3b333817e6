import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqframe.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "a plain text, and a plain text.", "two  spaces   here", " leading and trailing ", "\n\t lines \n and\ttabs\r\n", "naïve Ünïcödé e\u0301 ﬁ ①", "日本語のテキスト、漢字とかな", "🙂🙃 emoji 👩‍👩‍👧", "a\u00a0b\u3000c\u2003 d\u0085 e", "x\x00y\x1c z\x1f w", "<|endoftext|> <s> </s> <unk>", "a▁b no tokens", "▁", " ", "  ", "\n", "<0x41> '<s>'ll don't", "0123456789 3.14", "http://a.b/c?d=e&f", "\u200b zero", "x" * 3000, "長い" * 1500, "\ufffd \ud7ff",
]


def brute(texts):
    """Straight from the libraries: tokens by byte, overlaps and common ends one by one."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = {letter: i for i, letter in enumerate(align.byte_letters())}
    rows, held = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        parts_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if t and not (b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode()):
            ids_a, ids_b, parts_a, parts_b = [], [], [], []
        own_a, own_b = ([k for k, p in enumerate(parts) for _ in p] for parts in (parts_a, parts_b))
        links = sorted(set(zip(own_a, own_b)))
        links = [(ids_a[i], ids_b[j]) for i, j in links]
        ends = [set(np.cumsum([len(p) for p in parts]).tolist()) for parts in (parts_a, parts_b)]
        groups, i, j, at = [], 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            ga, gb = [], []
            while i < len(ids_a) and sum(map(len, ga)) < end - at:
                ga.append(parts_a[i])
                i += 1
            while j < len(ids_b) and sum(map(len, gb)) < end - at:
                gb.append(parts_b[j])
                j += 1
            groups.append(",".join(map(str, ids_a[i - len(ga) : i])) + "|" + ",".join(map(str, ids_b[j - len(gb) : j])))
            at = end
        held.update(set(links))
        rows.append((len(ids_a), len(ids_b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(n_a, n_b, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), ";".join(g)) for n_a, n_b, g, links in rows], held


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_alignment_equals_brute_force(spark, documents):
    texts = [r.text for r in documents.select("text").collect()] + TEXTS
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(table, A, B).collect()}
    want, held = brute([t or "" for t in texts])
    for k, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert got[k] == w, t
    assert len(got) == len(texts) and got[len(texts) - len(TEXTS) + TEXTS.index("a▁b no tokens")] == (0,) * 6 + ("",)
    counts = {(r.a, r.b): r.n for r in align.pair_counts(table, A, B).collect()}
    assert counts == dict(held)


def test_slices_agree(spark, documents):
    """The same rows whatever the slices are."""
    rows = documents.where("doc_id < 60")
    whole = sorted(map(tuple, align.align(rows.coalesce(1), A, B, digest=True).collect()))
    assert sorted(map(tuple, align.align(rows.repartition(3), A, B, digest=True, slice_size=3000).collect())) == whole


def test_pointers_reach_the_terminal_token():
    rng = np.random.default_rng(0)
    for _ in range(50):
        total = int(rng.integers(1, 200))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 60)), total)) for _ in range(2)]
        to, _ = align.successors(*ends)
        common = np.intersect1d(*ends)
        for k, e in enumerate(ends):
            mine = to[: len(ends[0])] if k == 0 else to[len(ends[0]) :]
            assert (ends[0][mine] == common[np.searchsorted(common, e)]).all()
    chain = np.arange(2, 100_001, 2), np.append(np.arange(1, 100_000, 2), 100_000)  # no common end but the last: the longest pointer chain
    assert set(align.successors(*chain)[0].tolist()) == {49_999}


def test_odd_rows(spark, odd, nothing):
    got = align.align(odd, A, B).collect()
    assert len(got) == odd.count() and list(got[0].asDict()) == ["doc_id", *COLUMNS]
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [tuple(r)[1:] for k in (2, 3) for r in by[k]] == [(0,) * 6 + ("",)] * 2
    assert by[1][0] == by[1][1] and by[5][0][1:] == by[6][0][1:] and by[5][0].n_links > 20_000 and by[None][0].n_a > 0
    assert align.align(nothing, A, B).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r.text or "" for r in docs])
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {d.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for d, w in zip(docs, want, strict=True)}
    assert got.where(F.col("n_best") > F.col("n_links")).count() == 0
