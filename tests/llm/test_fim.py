import hashlib
import re

import duckdb
import pytest

from seqframe.llm import fim, queries
from seqframe.llm.oracle import ORACLE_SQL

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = ["", " ", "one", " one", "one ", "one  two\n\nthree\t", "\n\n", "é 日本 🙂 x\u00a0y", "a<P>b", "ends in <", "<S", ">", "a <M", "x" * 5000, " " * 500 + "y" * 700 + " " * 900, "w " * 3000, "日本語" * 900 + " 語", "<" * 300 + " >" * 200]


def plain(text, key, seed=42, rate=50, spm=80):
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("frame", [1, 7, 64, fim.FRAME])
def test_output_and_restored_text(spark, frame):
    rows = [(k, t) for k, t in enumerate(TEXTS * 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    done = fim.rearrange(fim.pack(table, frame=frame))
    out = {r.doc_id: r.output for r in fim.texts(done).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    forms = set()
    for r in fim.digests(done).collect():
        text = rows[r.doc_id][1]
        *head, output = plain(text, r.doc_id)
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head and out[r.doc_id] == output
        assert (r.output_sha256, r.restored_sha256) == (digest(output), digest(text))
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_frames_seek():
    text = " ".join(f"wörd{i}" for i in range(5000)) + " \n"
    f = fim.compressed(text.encode(), 1000)
    units = UNIT.findall(text)
    assert len(f) > 40 and f.total(3) == len(units) and f.total(2) == len(text) and b"".join(f) == text.encode()
    read = []
    inner, f.read = f.read, lambda x: read.append(1) or inner(x)
    for n in (0, 1, 17, 2500, len(units) - 1, len(units)):
        del read[:]
        assert f.cut(n) == len("".join(units[:n]).encode()) and len(read) == (n > 0)
    del read[:]
    whole = sum(part is None for _, part in f.span(f.cut(100), f.cut(4900)))
    assert whole > len(f) * 0.8 and len(read) <= 4  # only frames with a cut are decompressed
    assert f.find(b"never") is None and f.find("wörd4999".encode())[0] == text.encode().find("wörd4999".encode())


def test_long_units_go_through_frames():
    text = ("x" * 10_000 + " ") * 3
    f = fim.compressed(text.encode(), 256)
    assert max(b - a for a, b in zip([0, *f.index[:, 1]], f.index[:, 1])) <= 256
    assert [f.cut(k) for k in range(5)] == [0, 10_000, 20_001, 30_002, 30_003]


def test_odd_rows(spark, odd, nothing):
    done = fim.digests(fim.rearrange(fim.pack(odd))).collect()
    assert len(done) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in done)
    assert {(r.n, r.form) for r in done if r.doc_id in (2, 3)} == {(0, "plain")}
    none = next(r for r in done if r.doc_id is None)
    assert (none.n, none.form, none.prefix_chars, none.middle_chars) == plain(texts[None], "")[:4]
    assert fim.digests(fim.rearrange(fim.pack(nothing))).count() == 0


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op12_fill_in_middle"])
    names = [d[0] for d in want.description]
    got = queries.op12_fill_in_middle(spark, sf)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
