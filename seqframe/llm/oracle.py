"""DuckDB SQL for the queries that SQL can express. The others hash with functions that
DuckDB lacks, need positions of regular expressions, or are learned; tests hold those
against brute force."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_SPACE = "\\x20\\x09-\\x0D"

#: op11. Aliases as the given pages have them: absolute addresses in canonical links and refreshes, compared without fragment.
_URL_SQL = f"""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(url, '#.*$', '', 's') AS node, coalesce(html, '') AS html,
translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(rule, host, path, allowed) AS (VALUES ('org/', 'org', '/', true), ('example.org/es/', 'example.org', '/es/', false), ('example.org/en/1', 'example.org', '/en/1', false), ('com/fr/', 'com', '/fr/', true), ('com/de/', 'com', '/de/', false)),
tags AS (SELECT node, unnest(regexp_extract_all(html, '<(?:link|meta)\\s[^>]*>', 0, 'i')) AS tag FROM p WHERE node <> ''),
e AS (SELECT node AS u, regexp_replace(v, '#.*$', '', 's') AS v FROM (SELECT node, CASE WHEN regexp_matches(tag, '^<link.*\\srel=["'']?canonical', 'is') THEN regexp_extract(tag, '\\shref=["'']?([^"'' >]+)', 1, 'i')
WHEN regexp_matches(tag, '^<meta.*http-equiv=["'']?refresh', 'is') THEN regexp_extract(tag, 'url=([^"'' >]+)', 1, 'i') END AS v FROM tags) WHERE regexp_matches(v, '^https?://', 'i')),
near AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
fits AS (SELECT x.host, x.path, arg_max(r.rule, len(r.rule)) AS rule, arg_max(r.allowed, len(r.rule)) AS allowed FROM (SELECT host, path FROM p UNION
SELECT translate(regexp_extract(v, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), regexp_extract(v, '^.*?://[^/?#]*([^?#]*)', 1, 's') FROM near) x
JOIN r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path) GROUP BY x.host, x.path),
bad(node) AS (SELECT u FROM near JOIN fits ON fits.host = translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AND fits.path = regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') WHERE NOT allowed
UNION SELECT v FROM near JOIN bad ON u = bad.node)
SELECT page_id, p.host, p.path, rule, CASE WHEN coalesce(allowed, p.node IS NULL OR p.node NOT IN (SELECT node FROM bad)) THEN 'allow' ELSE 'block' END AS verdict,
coalesce(p.node IN (SELECT node FROM bad), false) AS alias_blocked FROM p LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path"""

_FIM_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, [CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT) FOR k IN range(4)] AS x FROM d),
f AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM g"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
spans AS (SELECT *, least(13, len(w)) AS span FROM i WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, span, array_to_string(w[k + 1 : k + span], ' ') AS t FROM (SELECT *, unnest(range(len(w) - span + 1)) AS k FROM spans)),
doc_windows AS (SELECT doc_id, span, k, array_to_string(w[k + 1 : k + span], ' ') AS t FROM (SELECT doc_id, w, span, unnest(range(len(w) - span + 1)) AS k FROM d, (SELECT DISTINCT span FROM spans) WHERE len(w) >= span)),
hits AS (SELECT doc_id, span, k, item_id FROM doc_windows JOIN item_windows USING (span, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + span)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "op11_url_filter": _URL_SQL,
    "op12_fill_in_middle": _FIM_SQL,
}
