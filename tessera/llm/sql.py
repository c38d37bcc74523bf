"""DuckDB SQL for the results that SQL can express."""

OP1 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
    SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.other
), component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.node = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
"""

OP4 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS p FROM docs WHERE length(h) >= 100),
windows AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS w FROM places),
repeated AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS least FROM windows),
hits AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM repeated WHERE least < doc_id),
runs AS (SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
pieces AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS following FROM spans
), cut AS (
    SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
           string_agg(substring(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN following IS NULL THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
    FROM pieces s JOIN docs d ON d.doc_id = s.doc_id GROUP BY s.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE kept END)) AS kept_sha256
FROM docs d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""

OP6 = """
WITH d AS (
    SELECT doc_id, coalesce(CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) <> '' THEN 'domain' || CAST(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR) ELSE 'other' END, '') AS domain,
           coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
           CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens
    FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * 2 AS cap FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS DOUBLE) AS budget FROM leaves),
n1 AS (SELECT domain, CAST(sum(cap) AS DOUBLE) AS c, CAST(CASE domain WHEN 'domain0' THEN 4.0 WHEN 'domain1' THEN 3.0 WHEN 'domain2' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS w FROM leaves GROUP BY domain),
b1 AS (SELECT n.*, (SELECT budget FROM total) AS budget FROM n1 n ),
l1 AS (SELECT *, (budget - coalesce(sum(c) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
        FROM b1 WINDOW before AS ( ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f1 AS (SELECT *, arg_min(level, (c / w, domain)) FILTER (WHERE w * level < c) OVER () AS top FROM l1),
g1 AS (SELECT *, CASE WHEN top IS NULL THEN c ELSE least(c, w * top) END AS given FROM f1),
n2 AS (SELECT domain, lang, CAST(sum(cap) AS DOUBLE) AS c, CAST(CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS w FROM leaves GROUP BY domain, lang),
b2 AS (SELECT n.*, p.given AS budget FROM n2 n JOIN g1 p ON n.domain = p.domain),
l2 AS (SELECT *, (budget - coalesce(sum(c) OVER before, 0)) / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER before, 0)) AS level
        FROM b2 WINDOW before AS (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT *, arg_min(level, (c / w, lang)) FILTER (WHERE w * level < c) OVER (PARTITION BY domain) AS top FROM l2),
g2 AS (SELECT *, CASE WHEN top IS NULL THEN c ELSE least(c, w * top) END AS given FROM f2),
n3 AS (SELECT domain, lang, source, CAST(sum(cap) AS DOUBLE) AS c, CAST(1.0 AS DOUBLE) AS w FROM leaves GROUP BY domain, lang, source),
b3 AS (SELECT n.*, p.given AS budget FROM n3 n JOIN g2 p ON n.domain = p.domain AND n.lang = p.lang),
l3 AS (SELECT *, (budget - coalesce(sum(c) OVER before, 0)) / (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER before, 0)) AS level
        FROM b3 WINDOW before AS (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT *, arg_min(level, (c / w, source)) FILTER (WHERE w * level < c) OVER (PARTITION BY domain, lang) AS top FROM l3),
g3 AS (SELECT *, CASE WHEN top IS NULL THEN c ELSE least(c, w * top) END AS given FROM f3),
quota AS (
    SELECT l.domain, l.lang, l.source, CAST(floor(g.given) AS BIGINT) // l.tokens AS whole, CAST(floor(g.given) AS BIGINT) % l.tokens AS rest
    FROM leaves l JOIN g3 g ON l.domain = g.domain AND l.lang = g.lang AND l.source = g.source WHERE floor(g.given) > 0
), keyed AS (SELECT d.*, q.whole, q.rest, md5('17:' || q.whole || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS key FROM d JOIN quota q ON d.domain = q.domain AND d.lang = q.lang AND d.source = q.source),
taken AS (SELECT *, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM keyed)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, CAST(copies AS INTEGER) AS copies FROM taken WHERE copies > 0
"""
