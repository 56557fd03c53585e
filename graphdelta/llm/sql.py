"""DuckDB SQL of the operators that SQL can express, as plain brute force.  The
tables' ids are unique; the operators themselves don't need that."""
from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.r = ways.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, d.component_id
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) d LEFT JOIN sizes s USING (doc_id)"""

OP2 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
                              lambda x: x <> '') AS v FROM benchmark),
sized AS (SELECT item_id, v, len(v) AS m, least(len(v), 5) AS k FROM items WHERE len(v) > 0),
item_grams AS (
  SELECT item_id, m, k, j, array_to_string(v[j:j + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS j FROM sized)),
doc_grams AS (
  SELECT doc_id, n, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, len(w) AS n, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs, (SELECT DISTINCT k FROM sized))),
windows AS (
  SELECT DISTINCT doc_id, item_id, m, t.k, least(m, n) AS length,
    least(greatest(i - j, 0), n - least(m, n)) AS start
  FROM doc_grams d JOIN item_grams t ON d.g = t.g AND d.k = t.k),
in_window AS (
  SELECT x.doc_id, x.item_id, x.start, x.length, d.g, count(*) AS c
  FROM windows x JOIN doc_grams d ON d.doc_id = x.doc_id AND d.k = x.k
    AND d.i > x.start AND d.i <= x.start + x.length - x.k + 1
  GROUP BY ALL),
in_item AS (SELECT item_id, g, count(*) AS c FROM item_grams GROUP BY ALL),
totals AS (SELECT item_id, sum(c) AS total FROM in_item GROUP BY 1),
same AS (
  SELECT a.doc_id, a.item_id, a.start, a.length, sum(least(a.c, coalesce(b.c, 0))) AS s, sum(a.c) AS total
  FROM in_window a LEFT JOIN in_item b ON a.item_id = b.item_id AND a.g = b.g GROUP BY ALL),
judged AS (
  SELECT doc_id, item_id, start, length, s / (same.total + t.total - s) AS similarity
  FROM same JOIN totals t USING (item_id) WHERE 100 * s >= 80 * (same.total + t.total - s))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  round(CAST(similarity AS DOUBLE), 6) AS similarity
FROM judged QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


def _covered(length: int) -> str:
    """Words (p from 0) that lie in windows of so many words which start elsewhere too."""
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {length - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM words WHERE len(w) >= {length})),
again AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, i - 1 + k AS p
  FROM (SELECT doc_id, i FROM windows SEMI JOIN again USING (g)), (SELECT unnest(range(0, {length})) AS k))"""


OP7 = _covered(50) + """,
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 1 AS b
  FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM covered)
  GROUP BY doc_id, island)
SELECT d.doc_id, count(a) AS n_spans, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_repeated,
  coalesce(string_agg(a || ':' || b, ',' ORDER BY a), '') AS spans
FROM documents d LEFT JOIN runs r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""

OP8 = _covered(35) + """,
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id"""

OP9 = r"""
WITH lines AS (
  SELECT doc_id, k, string_split(content, ' ') AS w FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
      unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents)
  WHERE regexp_matches(content, '[^\x20\x09-\x0D]')),
grams AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM lines)),
sizes AS (SELECT doc_id, k, count(*) AS n FROM grams GROUP BY ALL),
shared AS (
  SELECT a.doc_id, a.k, b.doc_id AS doc2, b.k AS k2, count(*) AS c FROM grams a JOIN grams b
  ON a.g = b.g AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.k < a.k)) GROUP BY ALL),
removed AS (
  SELECT DISTINCT s.doc_id, s.k FROM shared s
  JOIN sizes x ON x.doc_id = s.doc_id AND x.k = s.k JOIN sizes y ON y.doc_id = s.doc2 AND y.k = s.k2
  WHERE 100 * s.c >= 80 * (x.n + y.n - s.c))
SELECT d.doc_id, CAST(len(string_split(coalesce(any_value(d.text), ''), chr(10))) AS BIGINT) AS n_lines,
  count(r.k) AS n_removed, coalesce(string_agg(CAST(r.k AS VARCHAR), ',' ORDER BY r.k), '') AS removed
FROM documents d LEFT JOIN removed r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""

OP11 = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
         ('0x' || h[17:24])::BIGINT % 100 AS f, ('0x' || h[25:32])::BIGINT % 100 AS g FROM drawn),
cuts AS (
  SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR f >= 90
              THEN 'plain' WHEN g < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT *, left(t, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""

OP12 = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20"""

OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS c FROM found GROUP BY ALL HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN vocabulary v USING (lang)
  LEFT JOIN totals t USING (lang, source)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b
  ON a.lang = b.lang AND a.source <> b.source),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value
  FROM pairs LEFT JOIN pair_values USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM every WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
WHERE part = 'pair' OR rank <= 10"""

SQL = {"op1_ngram_jaccard_join": OP1, "op2_benchmark_decontamination": OP2, "op7_suffix_array_dedup": OP7,
       "op8_substring_dedup": OP8, "op9_line_dedup": OP9,
       "op11_fill_in_middle": OP11, "op12_topk_search": OP12, "op13_source_divergence": OP13}
