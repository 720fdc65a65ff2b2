"""DuckDB SQL for the queries that SQL can express. The others are held against plain references in tests/llm."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "op2_extendible_sharding": r"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS b, count(*) AS c, count(DISTINCT h) AS k FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) GROUP BY 1, 2),
l AS (SELECT doc_id, n_bytes, min(depth) AS depth FROM d JOIN p ON p.prefix = h >> (60 - depth) WHERE b <= 65536 OR k = 1 GROUP BY doc_id, n_bytes, h)
SELECT l.doc_id, CAST(l.n_bytes AS BIGINT) AS n_bytes, l.depth, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(p.prefix), l.depth, '0') END AS shard, CAST(0 AS BIGINT) AS page,
  CAST(p.c AS BIGINT) AS shard_docs, CAST(p.b AS BIGINT) AS shard_bytes, p.b <= 65536 AS fits
FROM l JOIN d ON d.doc_id = l.doc_id JOIN p ON p.depth = l.depth AND p.prefix = d.h >> (60 - l.depth)""",
    "op3_epsilon_join": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
k AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, k.y FROM r JOIN k ON r.y = k.x),
c AS (SELECT x, min(y) AS root FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM k GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, c.root = e.vec_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap, CAST(list_extract([3, 1, 2], CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER)) AS DOUBLE) AS w FROM s),
v AS (SELECT a.source, ((SELECT sum(cap) / 2 * 1.5::DOUBLE FROM o) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0)) / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS lv, a.cap / a.w AS ratio
  FROM o a CROSS JOIN o b GROUP BY a.source, a.cap, a.w),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(lv) FROM v WHERE lv <= ratio)) AS target FROM o),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN least(CAST(floor(target + 0.5) AS BIGINT) // source_size, 2) ELSE 0 END AS copies FROM t),
x AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.copies, g.goal - g.copies * g.source_size AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(least(copies * size + greatest(0, least(size, budget - before)), 2 * size) AS BIGINT) AS taken FROM x""",
    "op9_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\b'), '<(/?s>|sep>)', '\\l\1', 'g'), '\[(/?INST\])', '\\k\1', 'g') AS safe,
  row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN before = role THEN 5 ELSE length(role) + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END END
    + CASE WHEN after = role THEN 0 WHEN role = 'assistant' THEN 4 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_ball_kmeans": r"""
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS q, row_number() OVER () AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT row, unnest(range(64)) AS i, CAST(unnest(q) AS BIGINT) AS x FROM e),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c FROM e ORDER BY c LIMIT 16),
k0 AS (SELECT s.c, v.i, v.x FROM s JOIN v ON v.row = s.row),
a0 AS (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN k0 k ON k.i = v.i GROUP BY v.row, k.c) GROUP BY row),
k1 AS (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM k0 k LEFT JOIN (SELECT a.c, v.i, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN a0 a ON a.row = v.row GROUP BY a.c, v.i) m ON m.c = k.c AND m.i = k.i),
a1 AS (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN k1 k ON k.i = v.i GROUP BY v.row, k.c) GROUP BY row),
k2 AS (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM k1 k LEFT JOIN (SELECT a.c, v.i, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN a1 a ON a.row = v.row GROUP BY a.c, v.i) m ON m.c = k.c AND m.i = k.i),
a2 AS (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN k2 k ON k.i = v.i GROUP BY v.row, k.c) GROUP BY row),
k3 AS (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM k2 k LEFT JOIN (SELECT a.c, v.i, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN a2 a ON a.row = v.row GROUP BY a.c, v.i) m ON m.c = k.c AND m.i = k.i),
a3 AS (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN k3 k ON k.i = v.i GROUP BY v.row, k.c) GROUP BY row),
n AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM k3 GROUP BY c)
SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, n.cluster_inertia, CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia, h.centroid_sha256
FROM e JOIN a3 a ON a.row = e.row JOIN n ON n.c = a.c JOIN h ON h.c = a.c""",
    "op12_filter_audit": r"""
WITH l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
  100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS fe FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, CAST(fa AS INTEGER) + 2 * CAST(fb AS INTEGER) + 4 * CAST(fc AS INTEGER) + 8 * CAST(fd AS INTEGER) + 16 * CAST(fe AS INTEGER) AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT o.filter_order, p.step, f.f, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE strpos(o.filter_order, g.f) < p.step) AS earlier
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) p, f WHERE strpos(o.filter_order, f.f) = p.step),
r AS (SELECT m.part, s.filter_order, s.step, s.f, coalesce(sum(n) FILTER (m.mask & CAST(s.earlier + s.bit AS INTEGER) = 0), 0) AS kept, coalesce(sum(n) FILTER (m.mask & CAST(s.earlier AS INTEGER) = 0 AND m.mask & s.bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (m.mask & CAST(s.earlier AS INTEGER) > 0 AND m.mask & s.bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (m.mask = s.bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (m.mask & CAST(s.earlier AS INTEGER) = 0 AND m.mask & s.bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (m.mask & CAST(s.earlier AS INTEGER) = 0 AND m.mask & s.bit > 0), 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
    "op13_warc_archives": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS owner FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((CAST('0x' || hex[5 * (i // 4) + 1 : 5 * (i // 4) + 5] AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN owner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM o""",
}
