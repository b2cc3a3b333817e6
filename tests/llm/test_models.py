import re

import numpy as np
from pyspark.sql import functions as F

from seqframe.llm import extract, langid, perplexity, vafile
from seqframe.llm.gru import BiGRU
from seqframe.llm.queries import _held_out

STOP = frozenset(w for words in extract.STOP_WORDS.values() for w in words)
SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    net = BiGRU(3, 4, 1)
    x, y, w = rng.integers(97, 110, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 3, 1]), np.ones((7, 5), np.float32)
    grad = net.gradients(x, y, w)[1]
    for name, p in net.p.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), p.shape)
        old, ends = p[at], []
        for e in (1e-2, -1e-2):
            p[at] = old + e
            ends.append(net.gradients(x, y, w)[0])
        p[at] = old
        np.testing.assert_allclose(grad[name][at], (ends[0] - ends[1]) / 2e-2, rtol=2e-2, atol=2e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs, langid.fit(docs, where=~_held_out()))
    right = got.join(docs, "doc_id").where(_held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and got.where("score not between 0 and 1").count() == 0


def test_language_odd_rows(odd, nothing):
    got = langid.predict(odd, langid.fit(odd, epochs=1)).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 8)} == {"und"} and {r.lang_pred for r in got if r.doc_id in (1, 5, 9)} == {"en"}
    assert langid.predict(nothing, langid.fit(odd, epochs=1)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(nothing)).collect()} == {"und"}


def test_quality_finds_junk(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = perplexity.classify(docs, labels.where("quality = 1")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    kept = dict(got)
    assert kept[1] > 0.97 and kept[0] < 0.15


def test_threshold_is_that_of_held_out_documents(spark):
    """Ties at the threshold are kept; what was counted says nothing about the threshold."""
    line = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(i, line if i % 3 else line[::-1], "en") for i in range(60)] + [(90, line, "fr"), (91, line, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.classify(docs, docs.where("doc_id < 60"), quantile=0.5).collect()}
    held = {r.doc_id for r in docs.where(perplexity.held_out("doc_id")).collect()} & set(range(60))
    worst = sorted(got[i].perplexity for i in held)[-(-len(held) // 2) - 1]
    assert 0 < len(held) < 60 and {r.threshold for r in got.values()} == {worst}
    assert all(r.keep == (r.perplexity <= worst) for r in got.values()) and any(r.perplexity == worst for r in got.values())


def test_quality_odd_rows(odd, nothing):
    trusted = odd.where("doc_id in (1, 5)")
    got = perplexity.classify(odd, trusted).collect()
    assert len(got) == odd.count() and {(r.perplexity, r.keep) for r in got if r.doc_id in (2, 3)} == {(None, False)}
    assert all(r.keep for r in got if r.doc_id == 1)
    assert perplexity.classify(nothing, trusted).count() == 0
    assert {r.keep for r in perplexity.classify(odd, nothing).where("perplexity is not null").collect()} == {True}


def exact_top(rows, k, dim):
    best = set()
    x = {(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and v}
    for i, q in x:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in x if j != i and len(v) == len(q))[:k]
            best |= {(i, n + 1, j, -a) for n, (a, j) in enumerate(s)}
    return best


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (551, [3.0, 1.0]), (600, []), (601, [1e8, 1.0]), (650, [1e6, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact_top(rows, 5, 8)
    for fit_rows in ((16_384, 4_096), (50, 3)):
        assert {tuple(r) for r in vafile.top_k(table, F.col("vec_id") % 50 == 0, fit_rows=fit_rows).collect()} == want
    assert vafile.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for size in (300, 1 << 40):
        x, q = rng.integers(-size, size, (200, 6)).astype(float), rng.integers(-size, size, (9, 6)).astype(float)
        lo, width = x.min(0), np.ceil((x.max(0) - x.min(0) + 1) / 8)
        cell = vafile.cells(x, lo, width, 3)
        low, high = vafile.bounds(q, cell, lo, width, 3)
        assert (low <= q @ x.T).all() and (q @ x.T <= high).all() and len(np.unique(cell)) == 8


def test_top_k_of_equal_vectors(spark):
    """A vector that many rows share: ties go to the smaller ids, in every block."""
    rows = [(i, [1.0, 2.0]) for i in range(150)] + [(i, [0.0, 1.0]) for i in range(150, 160)] + [(200, [3.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for fit_rows in ((16_384, 4_096), (20, 2)):
        assert {tuple(r) for r in vafile.top_k(table, F.col("vec_id") % 50 == 0, fit_rows=fit_rows).collect()} == exact_top(rows, 5, 2)


def test_top_k_beyond_exact_doubles(spark):
    """The same method for large numbers; extra columns may have the names used within."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * 10 ** rng.integers(0, 12)).tolist(), "x", 1) for i in range(120)] + [(0, [1.0] * 5, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, h int")
    got = {tuple(r) for r in vafile.top_k(table, F.col("vec_id") % 50 == 0, fit_rows=(30, 2)).collect()}
    x = {(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v, _, _ in rows}
    for i in (0, 50, 100):
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in x for n, q in x if n == i and j != i)[:5]
        assert {r for r in got if r[0] == i} == {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}


def test_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = re.sub(r"<[^>]*>", " ", inside)
        assert extract.main_text(r.html, STOP).split() == __import__("html").unescape(want).split()


def test_page_parts():
    page = """<body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies on this site for you</div><main><div class="post-header"><h1>Title</h1></div>
    <p>Short.</p><p>This is the long   text &amp; it goes on for the sake of the test,&nbsp;you see. It has some more of the words.</p><div class="shareButtons"><a href=x>Share</a></div>
    <ul><li>One<li>Two</ul><section id="comments"><p>Great post and I like it very much because it is the best of all of them.</p></section></main><aside>x</aside><form><label>Name</label></form></body>"""
    assert extract.main_text(page, STOP) == "Title\nShort.\nThis is the long text & it goes on for the sake of the test, you see. It has some more of the words.\nOne\nTwo"
    assert extract.main_text(None, STOP) == extract.main_text("", STOP) == extract.main_text("<script>x", STOP) == ""


PROSE = "This is one of the paragraphs that the article has, and it goes on for the sake of the test so that it is long enough to be judged by its words. "


def test_names_are_priors_only():
    """Names of elements around an article, or around all prose, don't empty the page."""
    article = f"<h1>Title of it</h1><p>{PROSE}</p><p>{PROSE * 2}</p>"
    want = ["Title of it", PROSE.strip(), (PROSE * 2).strip()]
    for around in ('<div class="layout has-sidebar"><article>%s</article></div>', '<div id="content" class="no-comments"><article>%s</article></div>', '<form id="aspnetForm"><article>%s</article></form>', '<form id="aspnetForm"><div>%s</div></form>', '<div class="sidebar"><main>%s</main></div>', '<div class="widget"><div>%s</div></div>', "<div><div>%s</div></div>"):
        page = f'<body><nav><a href=/>Home</a></nav>{around % article}<div class="sidebar"><p>Other things to see.</p></div><div id="comments"><p>{PROSE * 3}</p></div><footer>&copy; Us</footer></body>'
        assert extract.main_text(page, STOP).split("\n") == want, around
    comments = f'<article>{article}<section class="comments"><article class="comment"><p>{PROSE}</p></article></section></article>'
    assert extract.main_text(comments, STOP).split("\n") == want


def test_densities_decide():
    """Links, lengths and stop words, in and outside an article, and attributes of any length."""
    linked = '<p>This is <a href=1>one of the things that we have</a> and <a href=2>here is another one of them for you</a>, with more of it <a href=3>to be seen there</a>.</p>'
    menu = "<ul>" + "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(9)) + "</ul>"
    for tag in ("article", "div"):
        got = extract.main_text(f"<{tag}><p>{PROSE * 2}</p>{linked}<p>{PROSE * 2}</p>{menu}</{tag}>", STOP)
        assert "one of the things" in got and "Item" not in got
    for n in (3_999, 4_001, 50_000):
        assert extract.main_text(f'<article><p data-x="{"a>b" * n}">{PROSE}</p></article>', STOP) == PROSE.strip()
    russian = "Это первый абзац статьи, и в нём нет ни одного слова из списков, но он длинный и без ссылок, а значит это текст. " * 3
    assert extract.main_text(f"<div><ul><li><a>Дом</a><li><a>Мир</a></ul><p>{russian}</p><p>Коротко.</p><p>{russian}</p></div>", STOP).split("\n") == [russian.strip(), "Коротко.", russian.strip()]


def test_pages_without_article(spark):
    """Held-out form of the given pages: no tag says where the article is."""
    kept = total = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = __import__("html").unescape(re.sub(r"<[^>]*>", " ", inside)).split()
        got = extract.main_text(re.sub("(</?)article", r"\1div", r.html), STOP).split()
        total += len(want)
        kept += len(got) if got == want else sum(min(got.count(w), want.count(w)) for w in set(want))
        assert len(got) <= len(want)
    assert kept > 0.95 * total


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "v", "<a" * 30_000), (3, "w", "<article><p>" + "the word of it " * 50_000)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and max(r.n_chars for r in got) == 50_000 * 15 - 1
    clash = spark.createDataFrame([(1, "u", "<article><p>" + PROSE, "x", 5, "y")], "page_id long, url string, html string, text string, n_chars int, k string")
    assert [tuple(r) for r in extract.extract(clash).collect()] == [(1, "u", PROSE.strip(), len(PROSE.strip()))]
    assert extract.extract(clash.limit(0)).count() == 0


def test_an_article_keeps_what_is_named_by_its_words():
    """Names, ids and links within an article don't remove its text; menus and adverts in it still go."""
    def kept(*parts):
        page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{PROSE}</p>{''.join(parts)}<p>{PROSE}</p></article></body>"
        return extract.main_text(page, frozenset(w for words in extract.STOP_WORDS.values() for w in words)).split("\n")[2:-1]

    assert kept('<h2 id="search">Search trees</h2>') == ["Search trees"]
    assert kept('<h2 id="related-work">Related work</h2>') == ["Related work"]
    assert kept(f'<p class="social-history">{PROSE}</p>') == [" ".join(PROSE.split())]
    assert kept(f'<section id="related-work"><h2>Related</h2><p>{PROSE}</p><p>{PROSE}</p></section>') == ["Related", *[" ".join(PROSE.split())] * 2]
    assert kept("<p>See <a href=x>the full report of the committee</a>.</p>") == ["See the full report of the committee."]
    assert kept('<div class="share-buttons"><a href=x>Share</a></div>', f'<div class="ad">{PROSE}</div>', f'<section class="comments-area"><p>{PROSE}</p></section>') == []
    assert kept("<ul>" + "".join(f"<li><a href=x>Other page {i}</a></li>" for i in range(6)) + "</ul>") == []
    page = f"<body><p>{PROSE}</p><p>The sign \u00a9 stands for copyright and it is in this sentence of the text, which is a long one.</p><p>{PROSE}</p><p>\u00a9 Us</p></body>"
    assert extract.main_text(page, frozenset(extract.STOP_WORDS["en"])).count("\u00a9") == 1
