"""DuckDB SQL for the rows of the queries that SQL can express."""

OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM docs),
windows AS (
  SELECT doc_id, p AS pos, array_to_string(w[p : p + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT gram, min(doc_id) AS first_doc FROM windows GROUP BY gram),
hits AS (
  SELECT x.doc_id, x.pos FROM windows x JOIN firsts f ON x.gram = f.gram WHERE f.first_doc < x.doc_id),
marked AS (
  SELECT w.doc_id, w.pos, w.word,
         max(CASE WHEN h.pos IS NULL THEN 0 ELSE 1 END) OVER (
           PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id AND w.pos = h.pos),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(k.n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP4_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS whole FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
  WHERE s.both * 5 >= (x.n + y.n - s.both) * 4),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
same AS (SELECT whole, min(doc_id) AS first_doc FROM sizes GROUP BY whole)
SELECT d.doc_id, COALESCE(least(m.b, d.doc_id), d.doc_id) AS class_id, CAST(COALESCE(g.n, 0) AS BIGINT) AS n_links,
       COALESCE(t.first_doc, d.doc_id) AS text_class_id, COALESCE(least(m.b, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN least m ON d.doc_id = m.a LEFT JOIN degree g ON d.doc_id = g.a
LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN same t ON s.whole = t.whole
"""

OP5_SQL = r"""
WITH docs AS (
  SELECT source, lang,
         CASE WHEN doc_id % 5 = 0 THEN substring(text, CAST(floor(length(text) / 2) AS INT) + 1) ELSE text END AS text
  FROM documents WHERE doc_id % 7 <> 0),
v AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM docs
  UNION ALL
  SELECT source, lang, 'runs-2',
         COALESCE(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')), 0) FROM docs)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM v GROUP BY source, lang, tokenizer
"""

OP9_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(COALESCE(d.n, 0) AS BIGINT) AS n_links, COALESCE(least(m.b, v.vec_id), v.vec_id) AS component_id,
       COALESCE(least(m.b, v.vec_id), v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN degree d ON v.vec_id = d.a LEFT JOIN least m ON v.vec_id = m.a
"""

ORACLES = {
    "op3_substring_dedup": OP3_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op5_token_count_rollup": OP5_SQL,
    "op9_vector_near_duplicates": OP9_SQL,
}
