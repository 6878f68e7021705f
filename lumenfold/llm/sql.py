"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations


#: Lines of all documents, their keys, and the documents that hold each key.
OP5 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
       CAST(coalesce(sum(CASE WHEN s.keeper <> k.doc_id THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.keeper IS NULL OR s.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY k.doc_id
"""


#: Cosines of all pairs of a label in double precision, then components by repeated minima.
OP7 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, r.component_id, r.component_id = vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = e.vec_id
"""

#: Shared shingles of all pairs of documents, then components by reachability.
OP10 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, r.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = d.doc_id
"""


#: Words, lines and windows of eight words, one text at a time.
STATISTICS = r"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM worded)),
repeated AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, unnest(range(8)) AS k FROM repeated) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM worded w LEFT JOIN covered c ON c.doc_id = w.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
"""

#: Matches and the text between them; a match starts where all before it ends.
_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '{p}', 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", "[0-9a-f]+", "length(m) >= 32"),
)
SECRETS = (
    "WITH "
    + ", ".join(
        f"""
{name}_found AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS ms, string_split_regex(coalesce(text, ''), '{p}') AS ps FROM documents),
{name}_placed AS (
  SELECT doc_id, m, {k} AS k, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS pos
  FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM {name}_found))"""
        for k, (name, p, _) in enumerate(_KINDS, 1)
    )
    + ", spans AS ("
    + " UNION ALL ".join(f"SELECT doc_id, k, pos, '{name}:' || pos || ':' || (pos + length(m)) AS s FROM {name}_placed WHERE {keep.format(p=p)}" for name, p, keep in _KINDS)
    + """)
SELECT d.doc_id, count(s) FILTER (k = 1) AS n_assign, count(s) FILTER (k = 2) AS n_access, count(s) FILTER (k = 3) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY pos, k), '')) AS base_sha256
FROM documents d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id"""
)


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5, "op7_embedding_near_dedup": OP7, "op10_minhash_near_dedup": OP10, "quality_statistics": STATISTICS, "secret_base_spans": SECRETS}
