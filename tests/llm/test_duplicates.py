import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seqframe.llm import common, secrets, simhash, substrings
from seqframe.llm.components import connected


def labels(fingerprints):
    x = np.array(fingerprints, np.int64).view(np.uint64)
    near, out = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, np.arange(len(x))
    while True:
        new = np.where(near, out[None, :], len(x)).min(1)
        if (new == out).all():
            return out
        out = new


def test_fingerprint_by_hand():
    text = "The quick BROWN fox\tjumps  é"
    w = ["the", "quick", "brown", "fox", "jumps", "é"]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(4)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash.fingerprint(text) & (1 << 64) - 1 == bits
    assert simhash.fingerprint("  ") == 0 and simhash.fingerprint("One two") & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two", 42)


def test_dense_groups(spark):
    rng = np.random.default_rng(0)
    found = set()
    for base in rng.integers(-(2**63), 2**63 - 1, 15).tolist():
        for _ in range(60):
            x = base & (1 << 64) - 1
            for _ in range(int(rng.integers(0, 4))):
                x ^= 1 << int(rng.integers(0, 64))
            found.add(x - (1 << 64) if x >= 1 << 63 else x)
    found = sorted(found)
    made = simhash.links(spark.createDataFrame([(x,) for x in found], "fingerprint long"))
    got = dict(connected(made, "a", "b").collect())
    want = labels(found)
    assert [got.get(x, x) for x in found] == [found[k] for k in want]


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (7, 7)], "a long, b long")
    got = dict(connected(edges, "a", "b").collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == 100
    assert connected(edges.limit(0), "a", "b").count() == 0


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    """Spark sized them like the rows before explode, and the driver held 34 rows to a fingerprint."""
    plans, real = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id") % 200).alias("text"))
    found = simhash.near_duplicates(docs)
    assert found.count() == 300 and len(plans) == 5 and not any("Broadcast" in p for p in plans)
    made = spark.createDataFrame([(1, 2, [(0, 0, 9)], [(300, 4, 309)])], "id long, h long, base array<struct<start:int,kind:int,end:int>>, weak array<struct<start:int,kind:int,end:int>>")
    assert "Broadcast" not in secrets.linked(made)._jdf.queryExecution().executedPlan().toString()


def test_simhash_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {c for (k, _), c in by.items() if k in (2, 3, 4)} == {2} and {c for (k, _), c in by.items() if k in (5, 6)} == {5}
    assert simhash.near_duplicates(nothing).count() == 0


def brute(rows, span=50):
    docs = sorted((k, (t or "").encode()) for k, t in rows)
    first, out = {}, {}
    for k, t in docs:
        for i in range(len(t) - span + 1):
            first.setdefault(t[i : i + span], k)
    for k, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if first[t[i : i + span]] < k:
                gone[i : i + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[k, t] = (edges[::2].tolist(), edges[1::2].tolist(), np.frombuffer(t, np.uint8)[~gone].tobytes())
    return out


def test_repeats_equal_brute_force(spark, documents):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    rows = []
    for i in range(200):
        parts = [base[a : a + rng.randint(1, 160)] if rng.random() < 0.7 else "xyz" * rng.randint(0, 12) for a in (rng.randint(0, 2900) for _ in range(rng.randint(0, 6)))]
        rows.append((i * 3 % 401, "".join(parts)))
    rows += [(500, "a" * 300), (501, "ab" * 200), (502, "a" * 49), (503, "a" * 50), (504, None), (505, ""), (506, base * 3), (507, "q" + base[:200])]
    rows += [(1000 + r.doc_id, r.text) for r in documents.limit(60).collect()]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(rows)
    texts = {k: (t or "").encode() for k, t in rows}
    assert {r.doc_id: (list(r.starts), list(r.ends), bytes(r.kept)) for r in got} == {k: want[k, t] for k, t in texts.items()}


def test_long_text_in_pieces(spark):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, (1 << 20) + 5000).astype(np.uint8)).decode()
    rows = [(1, text[(1 << 20) - 300 : (1 << 20) + 300]), (2, text), (3, text[:200] + "#" + text[-200:])]
    got = {r.doc_id: (list(r.starts), list(r.ends)) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([], []), 2: ([(1 << 20) - 300], [(1 << 20) + 300]), 3: ([0, 201], [200, 401])}


def test_spread_grams(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    common = word(60)
    rows = [(i, word(70) + common[rng.randint(0, 4) :] + word(70)) for i in range(300)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = brute(rows)
    assert all((list(r.starts), list(r.ends)) == want[r.doc_id, dict(rows)[r.doc_id].encode()][:2] for r in got)


def test_repeats_odd_rows(odd, nothing):
    got = substrings.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    kept = {r.doc_id: len(r.kept) for r in got}
    assert kept[6] == 0 and kept[5] == {r.doc_id: r.n_bytes for r in got}[5] and kept[1] == 33
    assert substrings.remove_repeats(nothing).count() == 0


def test_places_are_sent_as_differences():
    """Before, four bytes each to a number of a document and a place, which Spark's compression left nearly as they were."""
    import zlib

    p = np.sort(np.random.default_rng(0).integers(0, 1 << 32, 5_000))
    for x in (p, p[::-1], np.array([0, (1 << 32) - 1, 0, 7]), p[:0]):
        assert (substrings._opened("p", substrings._packed("p", x)) == x.astype("<u4")).all()
    near = np.cumsum(np.random.default_rng(1).integers(1, 64, 5_000))
    assert len(zlib.compress(substrings._packed("p", near), 1)) < 2 * len(near)


def test_texts_travel_as_frames(spark):
    rows = spark.createDataFrame([(1, 2, "é" * 90), (2, 3, None), (3, 4, ""), (4, 5, "not let through")], "id long, h long, text string")
    some = spark.createDataFrame([(i, i, f"the text number {i * i} of many others " * 9) for i in range(900)], "id long, h long, text string")
    for known in (b"", substrings._dictionary(some)):
        got = {r.id: substrings._unframed(known)(r.z).decode() for r in substrings._frames(rows, known, common.bitmap(rows.where("id < 4"))).collect()}
        assert got == {1: "é" * 90, 2: "", 3: ""}
    assert substrings._dictionary(rows) == b"" and substrings._dictionary(some)


def test_shuffles_of_a_written_table_are_deleted(spark):
    """They stayed until the driver's memory was collected."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    real, before = spark.conf.get(common._FREE, None), files()
    made, _ = common.cut(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), free=True)
    assert files() <= before and spark.conf.get(common._FREE, None) == real and made.count() == 7
    common.cut(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() > before or real == "true"
