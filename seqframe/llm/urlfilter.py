"""URL filters with redirect equivalence, in DataFrame functions only.

judge() knows rules (host/path, allow or block). A rule fits its host and all subdomains,
if the url's path starts with the rule's; of those that fit, the longest text wins, then the
longer host, then allow. To find them a url is looked up under each suffix of its host that
has rules, with its path cut to each length that rules of that host have, so that rules of a
host never meet its urls one by one.

Urls that no rule fits get the method's verdict: pages name aliases, by canonical links and
refreshes in their html, and a table of redirects names more. The connected components of
these links (components.py: tables of a round are written and replace each other) are the
groups of aliases. A url is blocked if any member of its group is blocked by a rule, pages or
not; else it is allowed. Explicit allow rules have precedence: they hold for the urls that they fit, whatever their aliases are, and don't
undo the block of others.

Aliases are compared without fragment, with scheme and host in lower case, without the
scheme's own port, and with "/" for an empty path. Relative links are resolved (not by a
`base` element); links within comments, scripts and styles don't count. In a tag with more
than 200 quoted values no link is found, and other than web addresses are no aliases.

Null urls and those without "://" have an empty host and path; they are allowed and have no
aliases. Null html names none. Each input row gives one output row, repeated rows too; pages
with the same url share its aliases. Many pages may name one alias: their join is split if it
is skewed. Texts of any length are searched whole. Empty tables of pages, rules or redirects
are fine, and columns with other names aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut, has_rows
from seqframe.llm.components import connected

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = r"(?s)^.*?://(.*)$"
_QUOTED = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+){0,200}+>"""
_TAG = rf"(?is)<(?:link|meta)\s{_QUOTED}"
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*+>|\z)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and / ? # or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal(url: Column) -> Column:
    """The form by which aliases are compared; null for other than web addresses."""
    url = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = F.translate(F.regexp_extract(url, r"(?is)^(https?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z]+://[^/?]*(.*)$", 1)
    port = F.when(scheme == "http", F.lit(":80")).otherwise(F.lit(":443"))
    host = host_of(url)
    host = F.when(host.endswith(port), host.substr(F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, "" without one; the common character references are decoded."""
    pattern = rf"""(?is)[\s"']{name}\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    for written, sign in (("(?i)&(?:quot|#34|#x22);", '"'), ("(?i)&(?:#39|#x27);", "'"), ("(?i)&(?:amp|#38|#x26);", "&")):
        value = F.regexp_replace(value, written, sign)
    return F.trim(value)


def _resolved(target: Column, url: Column) -> Column:
    """An absolute address from one that may be relative to url."""
    origin = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    path = F.substring_index(target, "?", 1)
    query = target.substr(F.length(path) + 1, F.length(target))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    steps = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    tail = F.when(joined.rlike(r"(?s)/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^([^:/]*:)", 1), target))
        .when((target == "") | target.startswith("#"), url)
        .when(target.startswith("?"), F.concat(bare, target))
        .otherwise(F.concat(origin, F.array_join(steps, "/"), tail, query))
    )


def page_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Columns: url, target, kind (canonical or refresh): what pages name as their aliases, as it is written there, made absolute."""
    some = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    tags = some.select("url", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0)))).alias("tag"))
    link = F.col("tag").rlike(r"(?i)^<link")
    canonical = link & F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = ~link & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh")
    content = _attribute(F.col("tag"), "content")
    sent = F.regexp_extract(content, r"""(?is)^\s*+[0-9.]*+\s*+[;,\s]\s*+(?:url\s*+=\s*+)?["']?([^"']*+)""", 1)
    target = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.trim(sent))
    found = tags.select("url", target.alias("target"), F.when(link, F.lit("canonical")).otherwise(F.lit("refresh")).alias("kind")).where("target <> ''")
    return found.select("url", _resolved(F.col("target"), F.col("url")).alias("target"), "kind")


def rule_table(rules: DataFrame, *, rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """Columns: rule, host, path, allowed: one row to each rule, allow if it is given as both."""
    rows = rules.where(F.col(rule).isNotNull()).groupBy(F.col(rule).alias("rule")).agg(F.max(F.col(verdict) == ALLOW).alias("allowed"))
    host = F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER)
    return rows.select("rule", host.alias("host"), F.when(F.instr("rule", "/") > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("path"), "allowed")


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns: host, path, rule, allowed for each different host and path of urls that a rule fits."""
    table = rule_table(rules)
    lengths = table.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))  # different numbers, not rules
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    asked = places.where("host <> ''").select("host", "path", suffix.alias("suffix")).join(lengths.withColumnRenamed("host", "suffix"), "suffix")
    asked = asked.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.withColumn("start", F.expr("substring(path, 1, n)"))
    fits = asked.join(table.toDF("rule", "suffix", "start", "allowed"), ["suffix", "start"])
    best = F.max(F.struct((F.length("suffix") + F.length("start")).alias("size"), F.length("suffix").alias("host_size"), "allowed", "rule"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.allowed")


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Columns: key, host, path, rule (null if none fits), verdict, alias_blocked (boolean:
    a rule blocks some alias). rules: rule, verdict. redirects: url, target."""
    named = page_links(pages, url=url, html=html).select("url", "target") if html else None
    for more in [] if redirects is None else [redirects.select("url", "target")]:
        named = more if named is None else named.union(more)
    rows = pages.select(F.col(key), F.col(url).alias("__url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    blocked = None
    if named is not None:
        edges, _ = cut(named.select(normal(F.col("url")).alias("u"), normal(F.col("target")).alias("v")).where("u <> v").distinct())
        if has_rows(edges):
            groups, _ = cut(connected(edges, "u", "v"))
            members = groups.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
            verdicts = members.join(fitting(members, rules).where("not allowed"), ["host", "path"], "left_semi")
            blocked = groups.join(verdicts.select("component").distinct(), "component", "left_semi").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked"))
    found = fitting(rows, rules).select("host", "path", "rule", "allowed")
    out = rows.join(found, ["host", "path"], "left")
    if blocked is None:
        out = out.withColumn("__blocked", F.lit(False))
    else:
        out = out.withColumn("__node", normal(F.col("__url"))).join(blocked, "__node", "left")
    alias = F.coalesce("__blocked", F.lit(False))
    verdict = F.when(F.col("rule").isNotNull(), F.col("allowed")).otherwise(~alias)
    return out.select(key, "host", "path", "rule", F.when(verdict, ALLOW).otherwise(BLOCK).alias("verdict"), alias.alias("alias_blocked"))
