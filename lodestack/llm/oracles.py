"""The SQL of those queries that SQL expresses. In the tests op5_byte_bpe, op7_permutation_index and the stages of the pipeline are
held to plain results, op2_quality, op3_sharding and op9_language to properties and rates."""

from __future__ import annotations

from lodestack.llm.mixing import SIGNS

#: Sets of shingles of five words; links by counting common ones; the smallest id reachable over links.
MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
g AS MATERIALIZED (SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS MATERIALIZED (SELECT id, n, unnest(s) AS x FROM g),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT id, id AS top FROM g UNION SELECT p.a, r.top FROM r JOIN p ON p.b = r.id),
t AS (SELECT id, min(top) AS top FROM r GROUP BY id),
m AS (SELECT s.doc_id, t.top FROM s JOIN g ON list_sort(s.s) = g.s JOIN t ON t.id = g.id)
SELECT doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(m.top, doc_id) AS component_id, coalesce(m.top, doc_id) = doc_id AS kept
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: All products of queries and rows.
DUAL_TREE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 5"""

#: Keys, running sums and the level at which what capped sources leave is reshared.
MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  CASE WHEN length(text) > 0 THEN 0.25::DOUBLE + pow(length(translate(text, '{SIGNS}', '')) / length(text)::DOUBLE, 3) * 0.75 ELSE 0.25 END AS weight,
  (('0x' || substring(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / pow(2, 52) AS u FROM documents),
k AS (SELECT *, floor(-ln(u) / weight * pow(2, 32))::BIGINT AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM s),
l AS (SELECT *, ((SELECT 1.5 * sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w)::DOUBLE AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id::VARCHAR) - size / 2 AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

#: Prefixes of words in order of frequency meet; matches are counted on whole sets.
LINES = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
x AS MATERIALIZED (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s FROM l),
g AS MATERIALIZED (SELECT row_number() OVER () AS id, s, len(s) AS n, head FROM (SELECT s, min({'d': doc_id, 'i': i}) AS head FROM x WHERE len(s) > 0 GROUP BY s)),
e AS MATERIALIZED (SELECT id, n, head, unnest(s) AS w FROM g),
f AS (SELECT w, count(*) AS c FROM e GROUP BY w),
p AS MATERIALIZED (SELECT id, n, head, w FROM (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r FROM e JOIN f USING (w)) WHERE r <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p AS a JOIN p AS b ON a.w = b.w AND b.head < a.head AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
gone AS (SELECT DISTINCT x AS id FROM (SELECT x, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS common FROM c JOIN g AS a ON a.id = x JOIN g AS b ON b.id = y) WHERE 180 * common >= 80 * total),
k AS (SELECT x.doc_id, x.i, x.line, len(x.s) = 0 OR (g.head.d = x.doc_id AND g.head.i = x.i AND gone.id IS NULL) AS stays FROM x LEFT JOIN g ON g.s = x.s LEFT JOIN gone ON gone.id = g.id),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)"""

#: All windows of 200 bytes, as hexadecimal digits; removed bytes as runs of covered places.
SUBSTRINGS = r"""
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5_number(substring(h, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS s FROM b)),
r AS (SELECT doc_id, s FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS z FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM m) GROUP BY doc_id, g),
q AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS left_from, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM n),
u AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans,
  string_agg(substring(h, (2 * left_from + 1)::BIGINT, (2 * (a - left_from))::BIGINT) || CASE WHEN last THEN substring(h, (2 * z + 1)::BIGINT) ELSE '' END, '' ORDER BY a) AS kept FROM q JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN u USING (doc_id)"""

#: Lists of nodes by height; siblings are cut out of them by a leaf's rank, and folds run along a document's own list of siblings.
MANIFEST = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, lang, n_chars::VARCHAR AS n, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc FROM documents),
f AS (SELECT doc_id, source, crc, list_transform([doc_id::VARCHAR, source, lang, n], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v)::VARCHAR || ':' || v END) AS head, text, low FROM d),
e AS MATERIALIZED (SELECT doc_id, source, sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(text)::VARCHAR || ':' || text END) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(low)::VARCHAR || ':' || low END) END AS forged FROM f),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM e),
t AS (SELECT source, 0 AS h, list(leaf ORDER BY r) AS l FROM p GROUP BY source
  UNION ALL SELECT source, h + 1, list_transform(range(0, (len(l) + 15) // 16), lambda i: sha256(array_to_string(l[16 * i + 1:16 * i + 16], ''))) FROM t WHERE len(l) > 1),
s AS MATERIALIZED (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM t WHERE len(l) = 1),
u AS (SELECT 0 AS h, list(subroot ORDER BY k) AS l FROM s UNION ALL SELECT h + 1, list_transform(range(0, (len(l) + 15) // 16), lambda i: sha256(array_to_string(l[16 * i + 1:16 * i + 16], ''))) FROM u WHERE len(l) > 1),
w AS (SELECT p.doc_id, p.leaf, 0 AS tier, t.h, t.l, (p.r // pow(16, t.h)::BIGINT)::BIGINT AS i FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND len(t.l) > 1
  UNION ALL SELECT p.doc_id, p.leaf, 1, u.h, u.l, (s.k // pow(16, u.h)::BIGINT)::BIGINT FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN u ON len(u.l) > 1),
g AS (SELECT doc_id, leaf, list({'a': array_to_string(l[16 * (i // 16) + 1:i], ''), 'z': array_to_string(l[i + 2:16 * (i // 16) + 16], '')} ORDER BY tier, h) AS path FROM w GROUP BY doc_id, leaf),
o AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT l[1] FROM u WHERE len(l) = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.z), ''), '')) AS proof_sha256,
  list_reduce(list_prepend({'a': coalesce(p.forged, p.leaf), 'z': ''}, coalesce(path, [])), lambda x, y: {'a': sha256(y.a || x.a || y.z), 'z': ''}).a AS folded_root
  FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM p.doc_id AND g.leaf = p.leaf)
SELECT *, folded_root = root AS verified FROM o"""

#: All products of anchors and rows.
NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v AS a JOIN v AS c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % 50 = 0),
q AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM q JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

#: Grouping by the normalised text.
EXACT = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)"""
