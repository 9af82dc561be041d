"""DuckDB SQL of the queries that SQL can state on whole tables."""

from __future__ import annotations

from .winnow import BASES, PRIME

OP1 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
    SELECT *, regexp_replace(text, '([<\[])(%*)(\||/?s>|/?INST\])', '\1%\2\3', 'g') AS etext FROM rows),
conv AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length('<|start|>') + length(role) + 1 + length(etext) + length('<|end|>') + 1) AS formatted_chars
    FROM esc GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM conv
"""

OP6 = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP8 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
hit AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN first USING (win) WHERE m < doc_id),
word AS (
    SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text
    FROM word ANTI JOIN hit USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
        ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, c) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.c)
SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id
"""

OP12 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents),
nxt AS (
    SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt,
        coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
    FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
texts AS (
    SELECT doc_id, 0 AS kind, t FROM nxt
    UNION ALL SELECT doc_id, 1, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) FROM nxt),
points AS (
    SELECT doc_id, kind, generate_subscripts(cs, 1) - 1 AS i, CAST(unicode(unnest(cs)) AS BIGINT) + 1 AS c, len(cs) AS n
    FROM (SELECT doc_id, kind, regexp_extract_all(t, '(?s).') AS cs FROM texts)),
h1 AS (SELECT *, c AS a, c AS b FROM points),
h2 AS (SELECT doc_id, kind, i, n, (a * 1000000007 + lead(a, 1) OVER w) % 2147483647 AS a, (b * 1315423911 + lead(b, 1) OVER w) % 2147483647 AS b
    FROM h1 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
h4 AS (SELECT doc_id, kind, i, n, (a * {a2} + lead(a, 2) OVER w) % 2147483647 AS a, (b * {b2} + lead(b, 2) OVER w) % 2147483647 AS b
    FROM h2 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
h8 AS (SELECT doc_id, kind, i, n, (a * {a4} + lead(a, 4) OVER w) % 2147483647 AS a, (b * {b4} + lead(b, 4) OVER w) % 2147483647 AS b
    FROM h4 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
h16 AS (SELECT doc_id, kind, i, n, (a * {a8} + lead(a, 8) OVER w) % 2147483647 AS a, (b * {b8} + lead(b, 8) OVER w) % 2147483647 AS b
    FROM h8 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
runs AS (
    SELECT doc_id, kind, i, n, a * 2147483648 + b AS h FROM h16 WHERE i <= n - 16),
least AS (
    SELECT doc_id, kind, i, n, min((h::HUGEINT << 32) - i) OVER (
        PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS m
    FROM runs),
chosen AS (
    SELECT DISTINCT doc_id, kind, m FROM least WHERE i <= greatest(n - 47, 0)),
short AS (
    SELECT doc_id, kind, list_reduce(list(c ORDER BY i), lambda x, y: (x * 1000000007 + y) % 2147483647) AS a,
        list_reduce(list(c ORDER BY i), lambda x, y: (x * 1315423911 + y) % 2147483647) AS b
    FROM points WHERE n < 16 GROUP BY doc_id, kind),
entry AS (
    SELECT doc_id, kind, CAST((m + 4294967295) >> 32 AS BIGINT) AS h, CAST((((m + 4294967295) >> 32) << 32) - m AS BIGINT) AS i FROM chosen
    UNION ALL SELECT doc_id, kind, a * 2147483648 + b, 0 FROM short),
print AS (
    SELECT doc_id, kind, string_agg(printf('%016x%08x', h, i), '' ORDER BY i) AS f, count(DISTINCT h) AS size FROM entry GROUP BY ALL),
hashes AS (SELECT DISTINCT doc_id, kind, h FROM entry),
edited AS (SELECT a.doc_id, count(*) AS n_both FROM hashes a JOIN hashes b USING (doc_id, h) WHERE a.kind = 0 AND b.kind = 1 GROUP BY a.doc_id),
follows AS (
    SELECT nxt.doc_id, count(*) AS n_both FROM nxt JOIN hashes a ON a.doc_id = nxt.doc_id AND a.kind = 0
    JOIN hashes b ON b.doc_id = nxt.next_id AND b.kind = 0 AND b.h = a.h GROUP BY nxt.doc_id)
SELECT x.doc_id, CAST(length(x.t) AS BIGINT) AS n_chars, sha256(e.t) AS edited_sha256, coalesce(p.f, '') AS fingerprint,
    coalesce(q.f, '') AS edited_fingerprint,
    CASE WHEN coalesce(p.size, 0) + coalesce(q.size, 0) = 0 THEN 1.0::DOUBLE
        ELSE 2.0::DOUBLE * coalesce(edited.n_both, 0) / (coalesce(p.size, 0) + coalesce(q.size, 0)) END AS near_edited,
    CASE WHEN coalesce(p.size, 0) + coalesce(r.size, 0) = 0 THEN 1.0::DOUBLE
        ELSE 2.0::DOUBLE * coalesce(follows.n_both, 0) / (coalesce(p.size, 0) + coalesce(r.size, 0)) END AS near_next
FROM nxt x JOIN texts e ON e.doc_id = x.doc_id AND e.kind = 1
LEFT JOIN print p ON p.doc_id = x.doc_id AND p.kind = 0 LEFT JOIN print q ON q.doc_id = x.doc_id AND q.kind = 1
LEFT JOIN print r ON r.doc_id = x.next_id AND r.kind = 0
LEFT JOIN edited ON edited.doc_id = x.doc_id LEFT JOIN follows ON follows.doc_id = x.doc_id
""".format(
    **{f"{n}{e}": pow(b, e, PRIME) for n, b in zip("ab", BASES) for e in (2, 4, 8)}
)

ORACLE: dict[str, str] = {
    "op1_chat_format": OP1,
    "op6_topk_search": OP6,
    "op8_substring_dedup": OP8,
    "op9_minhash_neardup": OP9,
    "op12_fingerprints": OP12,
}
