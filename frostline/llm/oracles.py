"""DuckDB SQL of the operators whose contracts SQL can express, written plainly: whole windows and whole sets as strings."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def substring_sql(length: int) -> str:
    """Words in windows that also start in a document of a smaller id go; rows without an id stay whole."""
    return rf"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
place AS (
  SELECT r, doc_id, unnest([{{'i': i, 'word': w[i],
    'win': CASE WHEN i + {length - 1} <= len(w) THEN array_to_string(w[i:i + {length - 1}], ' ') END}}
    FOR i IN range(1, len(w) + 1)], recursive := true) FROM d),
x AS (SELECT r, doc_id, i, word, win FROM place),
f AS (SELECT win, min(doc_id) AS first FROM x WHERE win IS NOT NULL GROUP BY win),
b AS (SELECT x.*, CASE WHEN f.first < x.doc_id THEN i END AS bad FROM x LEFT JOIN f ON x.win = f.win),
g AS (SELECT *, coalesce(i - max(bad) OVER (PARTITION BY r ORDER BY i) < {length}, false) AS gone FROM b),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM g WHERE NOT gone GROUP BY r),
island AS (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS island FROM g WHERE gone),
span AS (SELECT r, min(i) - 1 AS s, max(i) AS e FROM island GROUP BY r, island),
cut AS (SELECT r, sum(e - s) AS n, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM span GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256, coalesce(cut.spans, '') AS removed
FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)"""


def linked_sql(k: int, percent: int, columns: str) -> str:
    """Sets of k-word shingles, all links between different sets, and the least id that links reach."""
    return rf"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(
    [array_to_string(w[a:a + {k - 1}], ' ') FOR a IN range(1, greatest(2, len(w) - {k - 2}))])) END AS shingles FROM d),
classes AS (
  SELECT shingles, len(shingles) AS n, min(doc_id) AS class_id, count(*) AS copies,
    row_number() OVER (ORDER BY min(doc_id)) AS class
  FROM sets WHERE doc_id IS NOT NULL AND len(shingles) > 0 GROUP BY shingles),
tokens AS (SELECT class, n, unnest(shingles) AS token FROM classes),
links AS (
  SELECT a.class AS a, b.class AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.class <> b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
counts AS (SELECT a AS class, sum(copies)::BIGINT AS n_links FROM links JOIN classes ON b = class GROUP BY a),
named AS (SELECT DISTINCT doc_id, class FROM sets JOIN classes USING (shingles) WHERE doc_id IS NOT NULL),
steps AS (
  SELECT a, b FROM links
  UNION SELECT x.class, y.class FROM named x JOIN named y ON x.doc_id = y.doc_id AND x.class <> y.class),
reach AS (SELECT class AS a, class AS b FROM classes UNION SELECT reach.a, steps.b FROM reach JOIN steps ON reach.b = steps.a),
roots AS (SELECT a AS class, min(doc_id) AS root FROM reach JOIN named ON b = named.class GROUP BY a),
told AS (
  SELECT sets.doc_id, len(sets.shingles) AS n_shingles, coalesce(root, sets.doc_id) AS component_id,
    coalesce(class_id, sets.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
  FROM sets LEFT JOIN classes ON sets.shingles = classes.shingles AND sets.doc_id IS NOT NULL
  LEFT JOIN roots USING (class) LEFT JOIN counts USING (class))
SELECT {columns} FROM told"""
