"""DuckDB SQL for the queries that SQL can express, by comparing everything with everything; for small tables only."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: From links x < y and both ways, the smallest id that each one reaches.
REACH = "both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x), least AS (SELECT x, min(y) AS y FROM reach GROUP BY 1), degree AS (SELECT x, count(*) AS n FROM both_ways GROUP BY 1)"
OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
 links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9), {REACH}
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, y) AS component_id, vec_id = least(vec_id, y) AS kept FROM embeddings LEFT JOIN least ON least.x = vec_id LEFT JOIN degree ON degree.x = vec_id"""
OP6 = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
 c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i : i + 34], ' ')) AS n FROM p),
 gone AS (SELECT DISTINCT doc_id, i + k AS i FROM c, range(35) t(k) WHERE n > 1),
 each_word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY 1)
 SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""
OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
 m AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM c JOIN m a ON a.doc_id = x JOIN m b ON b.doc_id = y WHERE 5 * k >= 4 * (a.n + b.n - k)), {REACH}
 SELECT doc_id, coalesce(n, 0) AS n_links, least(doc_id, y) AS component_id, doc_id = least(doc_id, y) AS kept FROM documents LEFT JOIN least ON least.x = doc_id LEFT JOIN degree ON degree.x = doc_id"""
OP8 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents), p AS (SELECT doc_id, b, unnest(range(0, len(b) // 2 - 399)) AS i FROM h),
 k AS (SELECT doc_id, i, hash(substr(b, 2 * i + 1, 800)) AS x FROM p), twice AS (SELECT x FROM k GROUP BY 1 HAVING count(*) > 1),
 r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM k SEMI JOIN twice ON k.x = twice.x),
 g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r), spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY 1, 2),
 parts AS (SELECT s.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before, b FROM spans s JOIN h ON h.doc_id = s.doc_id),
 kept AS (SELECT doc_id, count(*) AS n, sum(z - a) AS gone, string_agg(substr(b, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(b), 2 * max(z) + 1) AS b FROM parts GROUP BY 1)
 SELECT h.doc_id, len(h.b) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept.b, h.b))) AS kept_sha256 FROM h LEFT JOIN kept ON kept.doc_id = h.doc_id"""
