import random
import re

from pyspark.sql import functions as F

from seqframe.llm import decontaminate, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, span=13):
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(span, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(k))
    out = {}
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if x := windows.get(tuple(w[a : a + n])):
                    found |= x
                    hit.update(range(a, a + n))
        out[k] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(0)
    vocabulary = ["The", "of", "É", "é", "x1", "and", "in", "to"] + [f"w{i}" for i in range(30)]
    passage = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 14, 40]))] for _ in range(12)]
    items = [(i, " ".join(p)) for i, p in enumerate(passage)] + [(3, "of of of"), (90, None), (91, "..."), (92, " ".join(passage[-1]))]
    docs = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 8)):
            p = rng.choice(passage)
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))] + p[rng.randint(0, 1) :]
        docs.append((i, "; ".join(text)))
    docs += [(500, None), (501, ""), (502, " ".join(passage[5] * 400))]
    made = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in made.collect()} == brute(docs, items)


def test_contamination_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "text of the day twice here")], "item_id long, text string")
    got = decontaminate.contamination(odd, items).collect()
    assert len(got) == odd.count()
    assert [(r.n_hit, r.contaminated) for r in got if r.doc_id == 1] == [(6, True)] * 2 and not any(r.contaminated for r in got if r.doc_id != 1)
    assert decontaminate.contamination(nothing, items).count() == 0
    assert {r.n_items for r in decontaminate.contamination(odd, items.limit(0)).collect()} == {0}


KINDS = [
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    return sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))


def test_base_findings_and_redaction(spark):
    rng = random.Random(3)
    bits = ["token", "=", ":", " ", "'", '"', "secret", "abcdef12", "AKIA", "ABCD1234EFGH5678IJ", "0123456789abcdef0123456789", "é", "\n", "API_KEY", "passwd=", "x=", "user: bob1", "https://h.example/x"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, " ".join(f"token={i:08d}" for i in range(700)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(docs)
    out = found.join(docs, "doc_id").withColumns({"base": secrets.of_kind(F.col("spans"), *secrets.BASE), "clean": secrets.redacted(F.coalesce("text", F.lit("")), F.col("spans"))}).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [tuple(s) for s in r.base] == base_spans(r.text)
        text, want, at = r.text or "", "", 0
        if r.spans:
            joined = []
            for s in r.spans:
                if joined and s.start <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], s.end)
                else:
                    joined.append([s.start, s.end])
            for a, b in joined:
                want, at = want + text[at:a] + "[SECRET]", b
            assert r.clean == want + text[at:]


def test_weak_parts_need_a_partner(spark):
    lone, key = "see https://h.example/x or me@mail.example.com ", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5"
    rows = [(1, lone), (2, lone + "token = abcdef123"), (3, lone + "x" * 400 + " token = abcdef123"), (4, key), (5, "user: bob77 " + key), (6, key + " " + key)]
    got = {r.doc_id: {secrets.KINDS[s.kind] for s in r.spans} for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: set(), 2: {"assign", "endpoint", "identifier"}, 3: {"assign"}, 4: set(), 5: {"identifier", "candidate"}, 6: set()}


def test_long_parts(spark):
    """Parts are found however long they are: before, look-aheads and repeats ended at 200, 64, 63 and 15 characters."""
    who = "user: bob77 "
    for n in (10, 199, 201, 3000):
        texts = [who + "x" * n + "1" + "y" * 20, "token = abcdef123 " + "g" * n + "@" + "k" * n + ".example.com", "token = abcdef123 " + "s" * n + "://h.example/path"]
        found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        kinds = {r.doc_id: {secrets.KINDS[s.kind] for s in r.spans} for r in found}
        assert kinds == {0: {"identifier", "candidate"}, 1: {"assign", "identifier"}, 2: {"assign", "endpoint"}}


def test_secrets_odd_rows(odd, nothing):
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(nothing).count() == 0
