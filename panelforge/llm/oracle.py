"""DuckDB SQL of the operators that SQL can express: brute force on whole
tables, without any index."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_ANY = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Smallest id that a chain of links (a, b), given in both directions, reaches.
_REACH = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"

OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH},
n AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept FROM embeddings LEFT JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id"""

OP4 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ANY}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ANY}') AS w FROM benchmark),
s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS k FROM s),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
k AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM p, (SELECT DISTINCT n FROM win) WHERE s + n - 1 <= len(w)),
m AS (SELECT DISTINCT doc_id, s, n, item FROM k JOIN win USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT x) AS hits FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hits, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(hits, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM q x JOIN q y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), {_REACH}
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id"""

OP9 = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(1, octet_length(t) + 1)) AS p FROM d),
w AS (SELECT doc_id, p, t[p:p] AS c, CASE WHEN p + 49 <= octet_length(t) THEN t[p:p + 49] END AS g FROM p),
f AS (SELECT g, min(doc_id) AS m FROM w WHERE g IS NOT NULL GROUP BY g),
x AS (SELECT doc_id, p, c, max(CASE WHEN m < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS 49 PRECEDING) AS r FROM w LEFT JOIN f USING (g)),
y AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY p), 0) AS b FROM x),
z AS (SELECT doc_id, sum(r) AS n, sum(CASE WHEN r = 1 AND b = 0 THEN 1 ELSE 0 END) AS s, string_agg(hex(c), '' ORDER BY p) FILTER (r = 0) AS h FROM y GROUP BY doc_id)
SELECT doc_id, octet_length(t) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)"""
