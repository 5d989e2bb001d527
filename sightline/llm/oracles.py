"""DuckDB SQL for the queries that SQL can express, by brute force; for small tables."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Links by definition, and what they reach.
OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, e.vec_id) AS component_id, e.vec_id = coalesce(m.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id"""

#: All pairs that share a shingle.
OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1:i + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, least(len(w), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * x >= 80 * (m.n + o.n - x)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""

#: All 400-byte strings, as hexadecimal digits; all runs of 51 words without the signs at their ends, for the words in passages.
OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, CAST(2 * s + 1 AS BIGINT), 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)),
t AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM t)),
r AS (SELECT doc_id, k, min(s) AS a, max(s) + 400 AS b FROM i GROUP BY 1, 2),
g AS (SELECT doc_id, k, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), 1000000000000) AS b FROM r UNION ALL SELECT doc_id, 0, 0, min(a) FROM r GROUP BY 1),
k AS (SELECT g.doc_id, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (least(b, n) - a) AS BIGINT)), '' ORDER BY a) AS x FROM g JOIN d USING (doc_id) GROUP BY 1),
q AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY 1),
pw AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: coalesce(nullif(regexp_replace(x, '^[\x00-\x2f:-@\[-`{-\x7f]+|[\x00-\x2f:-@\[-`{-\x7f]+$', '', 'g'), ''), x)) AS w FROM documents),
ps AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 51], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 50)) AS s FROM pw WHERE len(w) > 50)),
pt AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s), 51) AS gap FROM ps WHERE h IN (SELECT h FROM ps GROUP BY h HAVING count(*) > 1)),
pq AS (SELECT doc_id, sum(least(gap, 51)) AS n FROM pt GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(q.removed, 0) AS BIGINT) AS n_removed, coalesce(q.spans, 0) AS n_spans, CAST(coalesce(pq.n, 0) AS BIGINT) AS n_passage_words, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN pq USING (doc_id)"""


_SPACE, _MARK = r"\t-\r\x{85}\p{Z}", "\uf8ff"


def _encoded(path: str, given: str) -> str:
    """CTEs that end with p(k, w, i), the pre-tokens of the texts of the relation `given` (k, text), and c(w, n, ids, bytes), each distinct one's ids and their bytes in hexadecimal digits.

    Byte-pair merges by the ranks of a file. SQL's patterns can't look ahead, so a mark first parts the last white space of a run from those before it."""
    little = "lpad(lower(to_hex(r % 256)), 2, '0') || lpad(lower(to_hex(r // 256 % 256)), 2, '0') || lpad(lower(to_hex(r // 65536 % 256)), 2, '0') || '00'"
    return rf"""
r AS (SELECT hex(from_base64(t)) AS t, r FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'BIGINT'}})),
e AS (SELECT k, regexp_extract_all(regexp_replace(text, '([{_SPACE}]+)([{_SPACE}])([^{_SPACE}])', '\1{_MARK}\2\3', 'g'), '{_MARK}|''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}{_MARK}]+|[{_SPACE}]+') AS w FROM {given}),
p AS (SELECT * FROM (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM e) WHERE w <> '{_MARK}'),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM p)),
b(w, parts) AS (
  SELECT w, CASE WHEN h IN (SELECT t FROM r) THEN [h] ELSE [h[2 * i + 1:2 * i + 2] FOR i IN range(0, len(h) // 2)] END FROM v
  UNION ALL
  SELECT w, parts[1:best.i - 1] || [parts[best.i] || parts[best.i + 1]] || parts[best.i + 2:] FROM (
    SELECT w, parts, min({{'r': r.r, 'i': i}}) AS best FROM (SELECT w, parts, unnest(range(1, len(parts))) AS i FROM b) x JOIN r ON r.t = x.parts[i] || x.parts[i + 1] GROUP BY w, parts)),
f AS (SELECT w, arg_min(parts, len(parts)) AS parts FROM b GROUP BY w),
c AS (SELECT w, count(*) AS n, string_agg({little}, '' ORDER BY i) AS ids, string_agg(r.t, '' ORDER BY i) AS bytes FROM (SELECT w, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM f) x JOIN r USING (t) GROUP BY w)"""


def op7(path: str) -> str:
    """The texts, and the texts after edit_counts.sample_edits(), encoded from the start."""
    return rf"""
WITH RECURSIVE d0 AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t0, length(coalesce(text, '')) AS n FROM documents),
d1 AS (SELECT *, t0[1:n // 4] || substr(t0, greatest(n // 2, 1), 24) || t0[n // 4 + 1:] AS t1 FROM d0),
d2 AS (SELECT *, t1[1:n // 2] || t1[n // 2 + 12:] AS t2 FROM d1),
d AS (SELECT *, t2[1:n * 3 // 4] || ' it''s 2024!' || chr(10) || chr(10) || t2[n * 3 // 4 + 6:] AS t3 FROM d2),
x AS (SELECT 2 * k AS k, t0 AS text FROM d UNION ALL SELECT 2 * k + 1, t3 FROM d),{_encoded(path, "x")},
g AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, count(*) AS words FROM p JOIN c USING (w) GROUP BY k)
SELECT d.doc_id, coalesce(a.n, 0) AS n_tokens, coalesce(a.words, 0) AS n_pretokens, coalesce(z.n, 0) AS n_tokens_after, true AS few_reencoded FROM d LEFT JOIN g a ON a.k = 2 * d.k LEFT JOIN g z ON z.k = 2 * d.k + 1"""


def op8(path: str) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),{_encoded(path, "d")},
g AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, string_agg(ids, '' ORDER BY i) AS ids, string_agg(bytes, '' ORDER BY i) AS bytes FROM p JOIN c USING (w) GROUP BY k)
SELECT d.doc_id, coalesce(g.n, 0) AS n_tokens, sha256(unhex(coalesce(g.ids, ''))) AS ids_sha256, sha256(unhex(coalesce(g.bytes, ''))) AS decoded_sha256 FROM d LEFT JOIN g USING (k)"""
