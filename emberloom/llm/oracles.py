"""SQL for DuckDB that gives the rows of the operators' queries by plain definitions:
joins on whole windows, whole shingles and whole vectors of words."""

from __future__ import annotations

from .licenses import LONG_WORDS, THRESHOLD, templates

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUBSTRING = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE lo < doc_id),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM p ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, d.b FROM r JOIN d ON r.reach = d.a)
SELECT node AS doc_id, n.n AS n_shingles, min(reach) AS component_id, node = min(reach) AS kept FROM r JOIN n ON n.doc_id = node GROUP BY node, n.n
"""

_ROWS = ", ".join("({}, '{}', '{}')".format(k, name, text.lower().replace("'", "''")) for k, (name, text) in enumerate(templates()))

LICENSES = rf"""
WITH t(k, license, txt) AS (VALUES {_ROWS}),
tw AS (SELECT k, license, unnest(regexp_extract_all(txt, '[\p{{L}}\p{{N}}]+')) AS w FROM t),
tf AS (SELECT k, license, w, count(*) AS n FROM tw GROUP BY ALL),
size AS (SELECT k, sum(n) >= {LONG_WORDS} AS long FROM tf GROUP BY k),
idf AS (SELECT w, ln((1 + {len(templates())}) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY w),
tv AS (SELECT k, license, w, n * idf AS x, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY k)) AS norm FROM tf JOIN idf USING (w)),
f AS (SELECT doc_id, text, coalesce(source, 'none') AS top, 'p' || (doc_id // 7 % 20) AS package, 'm' || (doc_id // 11 % 10) AS module FROM documents),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 10 <> 0 OR doc_id // 10 % 3 = 2 THEN top || '/' || package || '/' || module WHEN doc_id // 10 % 3 = 1 THEN top || '/' || package ELSE top END AS dir,
  CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE 'f' || doc_id || '.txt' END AS name FROM f),
ls AS (SELECT doc_id, lower(text) AS l, 0 AS i FROM files
  UNION ALL SELECT doc_id, unnest(string_split(lower(text), chr(10))), generate_subscripts(string_split(lower(text), chr(10)), 1) FROM files),
lw AS (SELECT doc_id, i, unnest(regexp_extract_all(l, '[\p{{L}}\p{{N}}]+')) AS w FROM ls),
lf AS (SELECT doc_id, i, w, count(*) AS n FROM lw GROUP BY ALL),
lv AS (SELECT doc_id, i, w, n * coalesce(idf, ln(1 + {len(templates())}) + 1) AS x FROM lf LEFT JOIN idf USING (w)),
ln_ AS (SELECT doc_id, i, sqrt(sum(x * x)) AS norm FROM lv GROUP BY ALL),
sc AS (SELECT lv.doc_id, k, license, sum(lv.x * tv.x) / any_value(tv.norm) / any_value(ln_.norm) AS s FROM lv JOIN tv USING (w) JOIN ln_ ON ln_.doc_id = lv.doc_id AND ln_.i = lv.i GROUP BY lv.doc_id, lv.i, k, license),
own AS (SELECT doc_id, license, round(least(s, 1), 9) AS score FROM sc JOIN size USING (k) WHERE s >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY long DESC, round(least(s, 1), 9) DESC, license) = 1),
o AS (SELECT files.doc_id, dir, dir || '/' || name AS path, name, license, score FROM files LEFT JOIN own USING (doc_id)),
held AS (SELECT dir, path, license, score FROM o WHERE license IS NOT NULL AND starts_with(name, 'LICENSE') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
near AS (SELECT o.doc_id, held.* FROM o JOIN held ON o.dir = held.dir OR starts_with(o.dir, held.dir || '/') WHERE o.license IS NULL QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(held.dir) DESC) = 1)
SELECT o.doc_id, o.path, coalesce(o.license, near.license) AS license, coalesce(o.score, near.score) AS score,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.license IS NOT NULL THEN o.path ELSE near.path END AS from_path
FROM o LEFT JOIN near ON near.doc_id = o.doc_id
"""
