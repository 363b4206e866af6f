"""DuckDB SQL for the queries that SQL can express."""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS c FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_links,
       least(v.vec_id, coalesce(low.m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(low.m, v.vec_id)) AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP9 = r"""
WITH w AS (
  SELECT doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
lens AS (SELECT d.doc_id, coalesce(sum(p.tf), 0) AS dl FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id),
g AS (SELECT count(*) AS n, avg(dl) AS mean FROM lens),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id,
         round(sum(q.tf * ln(1 + (g.n - f.df + 0.5) / (f.df + 0.5))
             * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / g.mean))), 6) AS score
  FROM p q JOIN p USING (term) JOIN f USING (term) JOIN lens l ON l.doc_id = p.doc_id, g
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

OP11 = r"""
WITH t AS (
  SELECT i, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM (SELECT row_number() OVER () AS i, doc_id, text FROM documents)),
p AS (SELECT i, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT i, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY i),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * g.docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM p, g GROUP BY term, g.docs),
q AS (SELECT j, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
      FROM (SELECT row_number() OVER () AS j, item_id, text FROM benchmark)),
a AS (SELECT j, item_id, term, count(*) AS c FROM q GROUP BY ALL),
s AS (SELECT a.j, a.item_id, p.i, p.doc_id,
        CAST(sum(a.c * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * d.n * g.docs) // g.words)))) AS BIGINT) AS score
      FROM a JOIN p USING (term) JOIN f USING (term) JOIN d ON d.i = p.i, g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id, i) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""

OP13 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM u),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM c),
l AS (SELECT doc_id, max(bad) AS bad FROM (
        SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad
        FROM labels) WHERE bad IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, count(*) AS n, sum(bad) AS bad
      FROM (SELECT host, TRY_CAST(regexp_extract(path, '(?s)^/[^/]+/([0-9]{1,18})([/.].*)?$', 1) AS BIGINT) AS doc_id FROM p) x
      JOIN l USING (doc_id) GROUP BY host),
h0 AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.?$', '') AS name FROM p),
h1 AS (SELECT host, name, regexp_matches(name, '^[0-9.]*$|^\[|:') AS address,
              array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS two,
              array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') AS three FROM h0),
h2 AS (SELECT *, CASE WHEN address THEN '' WHEN two IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn',
                'com.mx', 'gov.uk', 'org.uk') THEN two ELSE list_last(string_split(name, '.')) END AS suffix FROM h1),
h AS (SELECT host, suffix, CASE WHEN address THEN name WHEN contains(suffix, '.') THEN three ELSE two END AS domain,
             coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM h2 LEFT JOIN o USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
g AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS rate FROM s),
ks AS (SELECT 1 / coalesce(least(greatest((sum((bad - n * rate) ** 2 / (rate * (1 - rate))) - sum(n)) / nullif(sum(n * (n - 1)), 0),
              0.0001), 0.5), 0.5) - 1 AS k FROM s, g WHERE n > 0),
sm AS (SELECT suffix, (bad + k * rate) / (n + k) AS m FROM s, g, ks),
kd AS (SELECT 1 / coalesce(least(greatest((sum((bad - n * m) ** 2 / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0),
              0.0001), 0.5), 0.5) - 1 AS k FROM d JOIN sm USING (suffix) WHERE n > 0),
dm AS (SELECT domain, suffix, (bad + k * m) / (n + k) AS m FROM d JOIN sm USING (suffix), kd),
kh AS (SELECT 1 / coalesce(least(greatest((sum((bad - n * m) ** 2 / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0),
              0.0001), 0.5), 0.5) - 1 AS k FROM h JOIN dm USING (domain, suffix) WHERE n > 0),
ab AS (SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM h JOIN dm USING (domain, suffix), kh),
rep AS (SELECT host, round(1 / (1 + exp(-(ln(a / b) - 1.6448536269514722 * sqrt(1 / a + 1 / b)))), 6) AS bound FROM ab),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                         ('org', '/fr/', 'allow')),
j AS (SELECT p.*, rh || rp AS rule, rv, row_number() OVER (
             PARTITION BY page_id, p.host, path ORDER BY length(rh || rp) DESC, rh || rp DESC, rv DESC) AS k
      FROM (SELECT DISTINCT * FROM p) p LEFT JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, rule, CASE WHEN rule IS NOT NULL THEN rv WHEN bound >= 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       bound
FROM p JOIN j ON j.page_id IS NOT DISTINCT FROM p.page_id AND j.host = p.host AND j.path = p.path AND j.k = 1
JOIN rep ON rep.host = p.host
"""

ORACLE = {"op1_embedding_near_dedup": OP1, "op9_topk_search": OP9, "op11_blockmax_maxscore": OP11, "op13_url_filter": OP13}
