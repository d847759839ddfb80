"""DuckDB SQL for those numbered queries that SQL can express."""

from __future__ import annotations

_RULES = """(VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(v, h, p)"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = rf"""
WITH parts AS (
  SELECT page_id,
    {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|ref|gclid|fbclid)(=|$)'))), '&') AS kept FROM parts)),
listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.')),
ruled AS (
  SELECT page_id, max((length(h || p), length(h), v = 'block', h || p, v)) AS best
  FROM named, {_RULES} WHERE host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT n.page_id, host, path, best[4] AS rule,
  CASE WHEN best IS NOT NULL THEN best[5] WHEN host <> '' AND l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM named n LEFT JOIN ruled USING (page_id) LEFT JOIN listed l USING (canonical)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP11 = """
WITH named AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
digests AS (
  SELECT *, least IS NOT NULL AND page_id IS DISTINCT FROM least AS again, array_to_string(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest
  FROM named)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN least END AS refers_to
FROM digests
"""

OP12 = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals, count(*) OVER (PARTITION BY t) AS copies FROM texts),
masks AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * capitals > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least IS NOT NULL AND (doc_id IS NULL OR doc_id > least) THEN 16 ELSE 0 END AS mask FROM worded),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

OP13 = rf"""
WITH texts AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all({_LOWER.format("t")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS docs FROM found GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
pairs_of AS (SELECT DISTINCT lang, source FROM texts),
own AS (SELECT c.lang, source, term, c.n FROM counted c JOIN kept k USING (lang, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM pairs_of g JOIN langs l USING (lang) JOIN kept k USING (lang)
    LEFT JOIN totals t USING (lang, source) LEFT JOIN own o USING (lang, source, term)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM pairs_of g JOIN pairs_of h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 10
"""

SQL = {"op7_top_k": OP7, "op8_url_filter": OP8, "op11_warc": OP11, "op12_filter_audit": OP12, "op13_source_divergence": OP13}
