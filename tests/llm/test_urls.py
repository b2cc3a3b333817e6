import duckdb
import pytest
from pyspark.sql import functions as F

from seqframe.llm import queries, urlfilter
from seqframe.llm.oracle import ORACLE_SQL

RULES = queries.URL_RULES


def judged(spark, rows, rules=RULES, redirects=None):
    pages = spark.createDataFrame([(k, u, h, "x", "y", "z") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, rule string, component string")
    rules = spark.createDataFrame(rules, "rule string, verdict string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "url string, target string")
    return [tuple(r)[1:] for r in urlfilter.judge(pages, rules, redirects=redirects).orderBy("page_id").collect()]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and host and path.startswith(p):
            fits.append((len(rule), len(h), verdict == "allow", rule))
    return host, path, max(fits)[3] if fits else None


URLS = [
    None, "", "no scheme", "://", "http://", "http://example.org", "http://example.org/", "HTTP://WWW.Example.ORG/es/1?q#f", "https://example.org/en/1", "https://a.b.example.org/en/12/x", "https://notexample.org/es/", "https://org/x", "http://x.com/fr/a", "http://x.com/de/a",
    "http://x.com?/de/", "http://x.com#/de/", "http://com/de/", "http://.com/de/", "http://..org/", "ftp://x.org:80/es/", "http://ÉCOLE.org/É", "http://example.org/es", "a\n://example.org/es/", "http://u@x.com/de/", "http://x.net/http://example.org/es/",
]


def test_rules_equal_brute_force(spark):
    got = judged(spark, [(u, None) for u in URLS])
    for u, (host, path, rule, verdict, alias) in zip(URLS, got, strict=True):
        want = brute(u, RULES)
        assert (host, path, rule) == want, u
        assert verdict == (dict(RULES)[rule] if rule else "allow") and not alias


def test_many_rules(spark):
    rules = [(f"h{i % 50}.net/{'p' * (i % 7)}{i % 3}", "block" if i % 2 else "allow") for i in range(900)]
    rules = list(dict(rules).items()) + [("net/p", "block"), ("h1.net", "allow")]
    urls = [f"http://s.h{i % 60}.net/{'p' * (i % 9)}{i % 4}/x" for i in range(700)]
    got = judged(spark, [(u, None) for u in urls], rules)
    assert [(h, p, r) for h, p, r, _, _ in got] == [brute(u, rules) for u in urls]
    both = judged(spark, [("http://a.net/x", None)], [("net/", "block"), ("net/", "allow")])
    assert both == [("a.net", "/x", "net/", "allow", False)]


def link(target, kind="canonical"):
    return f'<head><LINK href="{target}" rel="{kind} other"></head>' if kind == "canonical" else f"<meta http-equiv=Refresh content='0; URL={target}'>"


def test_aliases_take_a_block(spark):
    rows = [
        ("http://a.net/1", link("http://b.net/2#x")),  # a - b - c: c is blocked by a rule
        ("http://b.net/2?", None),
        ("http://B.net:80/2", link("/3?a=1&amp;b=2", "refresh")),
        ("http://b.net/3?a=1&b=2", link("//example.org/es/9")),
        ("http://safe.org/", link("http://a.net/1")),  # explicit allow stays, and does not undo the others
        ("http://other.net/", link("http://other.net/")),
        ("http://c.net/d/e", link("../f/./g")),
        ("http://c.net/f/g", link("http://q.com/de/")),  # a target that is no page is judged too
        ("http://n.net/", "<!-- " + link("http://q.com/de/") + " --><script>'" + link("http://q.com/de/") + "'</script>"),
        ("http://m.net/", '<link title="a > b" rel=canonical href=http://q.com/de/x><link rel=stylesheet href="http://q.com/de/">'),
        ("http://r.net/", ""),
        ("http://r.net/", None),
    ]
    got = judged(spark, rows, redirects=[("http://r.net", "http://a.net/1"), (None, "http://x.y/"), ("http://z.net/", None)])
    assert [r[4] for r in got] == [True, False, True, True, True, False, True, True, False, True, True, True]
    assert [r[3] for r in got] == ["block", "allow", "block", "block", "allow", "allow", "block", "block", "allow", "block", "block", "block"]


def test_a_popular_alias_and_a_long_chain(spark):
    rows = [(f"http://p{i}.net/", link("http://hub.net/")) for i in range(400)] + [("http://hub.net/", link("http://c0.net/"))]
    rows += [(f"http://c{i}.net/", link(f"http://c{i + 1}.net/")) for i in range(60)] + [("http://c60.net/", link("http://x.com/de/"))]
    rows += [("http://free.net/", link("http://free.net/home"))]
    assert [r[3] for r in judged(spark, rows)] == ["block"] * 462 + ["allow"]


def test_links_are_found_in_any_text(spark):
    tags = "".join(f'<meta name="n{i}" content="canonical {i}">' for i in range(3000))
    long = "<p>" + "canonical words > " * 60_000 + "</p>"
    many = "<link " + " ".join(f"a{i}='canonical'" for i in range(199 - 2)) + " rel='canonical' href='http://x.com/de/'>"
    odd = "<link rel=\"canonical' <p> " * 2000
    rows = [("http://a.net/", tags + long + link("http://x.com/de/")), ("http://b.net/", many), ("http://c.net/", odd), ("http://d.net/", link("javascript:void(0)")), (None, link("http://x.com/de/"))]
    assert [r[4] for r in judged(spark, rows)] == [True, True, False, False, False]


def test_odd_tables(spark):
    assert judged(spark, []) == []
    assert judged(spark, [("http://x.com/de/", None)], []) == [("x.com", "/de/", None, "allow", False)]


def test_sql_agrees(spark, tmp_path):
    rows = [(k, u, None) for k, u in enumerate(URLS)]
    rows += [(100, "http://a.net/1", link("http://b.net/2")), (101, "http://b.net/2", link("http://x.com/de/", "refresh")), (102, "http://s.org/", link("http://b.net/2")), (103, "http://c.net/", link("http://c.net/x"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for sf, files in ((str(tmp_path), f"{tmp_path}/pages.parquet/*.parquet"), ("/root/testdata/sf0.001", "/root/testdata/sf0.001/pages.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{files}'")
        want = con.execute(ORACLE_SQL["op11_url_filter"])
        names = [d[0] for d in want.description]
        got = queries.op11_url_filter(spark, sf)
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
