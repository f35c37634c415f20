"""SQL for DuckDB of the operators that it can express: joins of whole tables with themselves, by brute force."""

#: Links as (k, j) pairs of classes; each class k with the least id of those that links reach.
_REACHED = """, r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, links.j FROM r JOIN links ON r.b = links.k),
comp AS (SELECT r.a AS k, min(c.least) AS component FROM r JOIN c ON r.b = c.k GROUP BY r.a),
linked AS (SELECT links.k, sum(c.m) AS n FROM links JOIN c ON links.j = c.k GROUP BY links.k) """

#: Vectors that link with nothing have no class.
OP3 = """WITH RECURSIVE e AS (SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN NULL ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings),
c AS (SELECT v AS k, v, count(*) AS m, min(vec_id) AS least FROM e WHERE v IS NOT NULL GROUP BY v),
links AS (SELECT a.k, b.k AS j FROM c a JOIN c b ON a.k <> b.k AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9)""" + _REACHED + """
SELECT vec_id, CAST(coalesce(c.m - 1 + coalesce(linked.n, 0), 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM e LEFT JOIN c ON e.v = c.k LEFT JOIN comp ON comp.k = c.k LEFT JOIN linked ON linked.k = c.k"""

#: Bytes as two hexadecimal digits each.
OP6 = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, length(h) // 2 - 199)) AS p, h FROM d WHERE length(h) >= 400),
s AS (SELECT r, p, hash(substr(h, 2 * p + 1, 400)) AS k FROM w),
hit AS (SELECT r, p FROM s SEMI JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
run AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS island FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM run GROUP BY r, island),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM span)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS n_removed, count(s) AS n_spans,
sha256(unhex(coalesce(string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s), '') || substr(h, 2 * coalesce(max(e), 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gap USING (r) GROUP BY r, doc_id, h"""

#: Texts with equal sets of n-grams are one class.
OP9 = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS grams FROM t),
h AS (SELECT doc_id, md5(array_to_string(grams, chr(10))) AS k, grams FROM g),
c AS (SELECT k, min(doc_id) AS least, count(*) AS m, any_value(grams) AS grams, len(any_value(grams)) AS n FROM h GROUP BY k),
u AS (SELECT k, n, unnest(grams) AS gram FROM c),
links AS (SELECT a.k, b.k AS j FROM u a JOIN u b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)))""" + _REACHED + """
SELECT doc_id, coalesce(component, c.least) AS class_id, CAST(c.m - 1 + coalesce(linked.n, 0) AS BIGINT) AS n_links, c.least AS copy_of, c.m AS n_copies
FROM h JOIN c USING (k) LEFT JOIN comp USING (k) LEFT JOIN linked USING (k)"""
