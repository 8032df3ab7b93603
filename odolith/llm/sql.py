"""SQL of the queries, written from their definitions for another engine; regular expressions are plain there."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def spans(table: str, kind: str, rank: int, pattern: str, keep: str) -> str:
    """Rows (doc_id, rank, kind, lo, hi, m) of the matches of `pattern` that pass `keep` (of m)."""
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, lo, lo + length(m) AS hi, m FROM (
  SELECT doc_id, unnest(hits) AS m,
    unnest(list_transform(range(1, len(hits) + 1), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT))) AS lo
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM {table} WHERE regexp_matches(text, '{p}')))
WHERE {keep}"""


TEXTS = "texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4 = f"""
WITH {TEXTS},
found AS ({' UNION ALL '.join([
    spans('texts', 'assign', 0, _ASSIGN + '[A-Za-z0-9+/_.=-]+', "length(regexp_replace(m, '^" + _ASSIGN.replace("'", "''") + "', '')) >= 8"),
    spans('texts', 'access', 1, 'AKIA[A-Z0-9]+', 'length(m) >= 16'),
    spans('texts', 'hex', 2, '[0-9a-f]+', 'length(m) >= 32'),
    spans('texts', 'pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 'true'),
    spans('texts', 'hosted', 4, 'gh[pousr]_[A-Za-z0-9]{36,}', 'true'),
])}),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN per USING (doc_id)
"""

OP8 = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM comp c LEFT JOIN n ON n.a = c.vec_id
"""


OP11 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, p, verdict)),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
patterns AS (SELECT * FROM (VALUES ('||ads-track.', '^([^/]*\.)?ads-track\.'), ('||ad-track.', '^([^/]*\.)?ad-track\.'), ('||adserver.', '^([^/]*\.)?adserver\.'), ('||spam-farm.', '^([^/]*\.)?spam-farm\.'),
  ('||link-farm.', '^([^/]*\.)?link-farm\.'), ('||tracker.', '^([^/]*\.)?tracker\.'), ('||tracking.', '^([^/]*\.)?tracking\.'), ('/adserver/', '/adserver/'), ('/click-track/', '/click-track/'),
  ('||*-casino.', '-casino\.'), ('/phishing/', '/phishing/'), ('||*.doubleclick.', '\.doubleclick\.')) AS v(pattern, re)),
own AS (SELECT host, path, arg_max(pattern, (length(pattern), pattern)) AS pattern FROM (SELECT DISTINCT host, path FROM u) JOIN patterns ON regexp_matches(host || path, re) GROUP BY host, path)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, CASE WHEN own.pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict, CASE WHEN best.rule IS NULL THEN own.pattern END AS pattern
FROM u LEFT JOIN best ON best.host = u.host AND best.path = u.path LEFT JOIN own ON own.host = u.host AND own.path = u.path
"""


def _canonical(text: str) -> str:
    from odolith.llm import licences

    out = f"regexp_replace(lower({text}), '{licences.COPYRIGHT_LINE}', ' ', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for other, plain in licences.EQUIVALENT:
        out = f"replace({out}, ' {other} ', ' {plain} ')"
    return f"trim({out})"


def op3() -> str:
    from odolith.llm import licences

    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licences.KNOWN)
    return f"""
WITH {TEXTS},
known AS (SELECT DISTINCT licence, {_canonical('text')} AS form FROM (VALUES {known}) AS k(licence, text)),
whole AS (SELECT t.doc_id, min(k.licence) AS licence FROM texts t JOIN known k ON k.form <> '' AND {_canonical('t.text')} = k.form GROUP BY t.doc_id),
lines AS (SELECT DISTINCT l.doc_id, k.licence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) l JOIN known k ON k.form <> '' AND {_canonical('l.line')} = k.form
  WHERE regexp_matches(l.line, '(?i)licen[cs]e|\\bCC0\\b|SPDX')),
per AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS notices FROM lines GROUP BY doc_id)
SELECT t.doc_id, w.licence, coalesce(p.notices, '') AS notices FROM texts t LEFT JOIN whole w USING (doc_id) LEFT JOIN per p USING (doc_id)
"""
