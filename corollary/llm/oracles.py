"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

#: Shingles of three words, links by the sizes of intersections, and components by recursion.
OP2 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(m.v, d.doc_id)) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS v FROM reach GROUP BY 1) m ON m.u = d.doc_id
"""

#: Lines as sets of words; a line goes if an earlier one has a Jaccard similarity of 0.8.
OP5 = r"""
WITH lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
classes AS (SELECT line, min((doc_id, pos)) AS first FROM worded GROUP BY 1),
tokens AS (SELECT DISTINCT first, unnest(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS t FROM classes),
sizes AS (SELECT first, count(*) AS n FROM tokens GROUP BY 1),
later AS (
  SELECT DISTINCT b.first FROM tokens a JOIN tokens b ON a.t = b.t AND a.first < b.first
  JOIN sizes x ON x.first = a.first JOIN sizes y ON y.first = b.first
  GROUP BY a.first, b.first, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
judged AS (
  SELECT l.doc_id, l.pos, l.line, w.line IS NOT NULL AS worded,
    w.line IS NOT NULL AND ((l.doc_id, l.pos) <> c.first OR c.first IN (SELECT first FROM later)) AS gone
  FROM lines l LEFT JOIN worded w ON w.doc_id = l.doc_id AND w.pos = l.pos LEFT JOIN classes c ON c.line = w.line)
SELECT doc_id, count(*) FILTER (worded)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY 1
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

#: All pairs of a label by cosine.
OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.v, e.vec_id)) AS component_id, least(e.vec_id, coalesce(m.v, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY 1) n ON n.u = e.vec_id LEFT JOIN (SELECT u, min(v) AS v FROM reach GROUP BY 1) m ON m.u = e.vec_id
"""

#: Windows of 20 words that start earlier elsewhere, the words that they cover, and runs of them along one reference.
OP7 = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM docs WHERE len(w) >= 20)),
placed AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY k) AS first FROM windows),
later AS (SELECT doc_id, i, first FROM placed WHERE first <> (doc_id, i)),
starts AS (SELECT a.doc_id, count(*) AS n FROM later a LEFT JOIN later b ON b.doc_id = a.doc_id AND b.i = a.i - 1 AND b.first[1] = a.first[1] AND b.first[2] = a.first[2] - 1 WHERE b.i IS NULL GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(generate_series(0, 19)) AS o)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM docs WHERE len(w) > 0),
judged AS (SELECT w.doc_id, w.x, w.i, g.i IS NOT NULL AS gone FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i),
summed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.g, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256, coalesce(f.n, 0)::BIGINT AS n_factors
FROM docs d LEFT JOIN summed s ON s.doc_id = d.doc_id LEFT JOIN starts f ON f.doc_id = d.doc_id
"""

SQL = {"op7_substring_dedup": OP7, "op2_minhash_dedup": OP2, "op5_line_dedup": OP5, "op6_embedding_dedup": OP6}
