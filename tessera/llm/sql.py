"""SQL of the queries whose rows take more than a few lines of it."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: 50-byte strings as hex, cut from blocks of 1000 so that no long text is walked for each of them.
SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(strlen(h) // 2 AS BIGINT) AS n FROM d),
b AS (SELECT doc_id, h, n, unnest(range(0, n - 49, 1000)) AS base FROM n WHERE n >= 50),
c AS (SELECT doc_id, base, n, substr(h, 2 * base + 1, 2 * 1049) AS part FROM b),
w AS (SELECT doc_id, base + i AS p, substr(part, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1000, n - 49 - base))) AS i FROM c)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE f.least < doc_id),
o AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS o FROM hit),
g AS (SELECT doc_id, p, sum(o) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM o),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, g.g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
j AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS gone, count(*) AS spans FROM k JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN j USING (doc_id)
"""

def jaccard(k: int, percent: int, kept: bool = False) -> str:
    """Components of documents whose k-word shingles are similar enough. Documents with equal sets are one class; roots spread along links and the smallest stays."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(list_sort(g), chr(10))) AS k FROM s),
c AS (SELECT k, any_value(n) AS n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY k),
t AS (SELECT c.rep, c.n, unnest(s.g) AS g FROM c JOIN s ON s.doc_id = c.rep),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * i >= {percent} * (na + nb - i)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(rep, root) AS (SELECT rep, rep FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.rep AND r.root < l.b),
m AS (SELECT rep, min(root) AS root FROM r GROUP BY rep)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.root, n.doc_id) AS component_id{", n.doc_id = coalesce(m.root, n.doc_id) AS kept" if kept else ""} FROM n LEFT JOIN c ON c.k = n.k AND n.n > 0 LEFT JOIN m ON m.rep = c.rep
"""


_TAIL = r"""["'']?\x20*[:=]\x20*["'']?"""
#: Kind, text it is found in (low: A-Z as a-z), pattern; a key is a whole run of its characters, so the pattern takes runs.
_PATTERNS = (
    ("assign", "low", rf"(password|passwd|secret|token|api_?key){_TAIL}([a-z0-9+/_.=-]+)"),
    ("access", "t", r"AKIA[A-Z0-9]+"),
    ("hex", "t", r"[0-9a-f]{16,}"),
    ("ident", "low", rf"\b(?:client|user|account|access|app|application|tenant|project)[_-]?(?:key_?)?id{_TAIL}([a-z0-9@._-]{{6,}})"),
    ("key", "t", r"[A-Za-z0-9+/_=-]{20,}"),
    ("endpoint", "low", r"""(?:\b(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3|ftps?|ssh)://[^\x09-\x0D\x20"''<>]+|\b[a-z0-9][a-z0-9.-]*\.(?:amazonaws\.com|windows\.net|googleapis\.com)\b)"""),
)
_FOUND = "\n    UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{kind}' AS kind, regexp_extract_all({column}, '{pattern}') AS m, string_split_regex({column}, '{pattern}') AS g FROM d" for i, (kind, column, pattern) in enumerate(_PATTERNS))
_JOINED = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b)"

#: Matches of a pattern lie between the pieces that it splits a text into, which gives their places.
SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
f AS ({_FOUND}),
u AS (SELECT doc_id, rank, kind, unnest(m) AS m, unnest(g[: len(m)]) AS g, unnest(range(len(m))) AS i FROM f WHERE len(m) > 0),
v AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM u),
x AS (SELECT doc_id, rank, kind, m, b - length(m) AS a, b FROM v),
s AS (SELECT * FROM x WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{_PATTERNS[0][2]}', 2)) >= 12 WHEN 'access' THEN length(m) >= 18
    WHEN 'key' THEN regexp_matches(m, '^[A-Za-z0-9+/_-]{{20,128}}={{0,2}}$') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE TRUE END),
k AS (SELECT * FROM s WHERE kind <> 'key' OR NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.kind <> 'key' AND o.a < s.b AND o.b > s.a)),
y AS (SELECT * FROM k WHERE rank < 3
    OR (kind = 'key' AND EXISTS (SELECT 1 FROM k o WHERE o.doc_id = k.doc_id AND o.kind IN ('access', 'ident', 'endpoint') AND o.a <= k.b + 240 AND o.b >= k.a - 240))
    OR (kind IN ('ident', 'endpoint') AND EXISTS (SELECT 1 FROM k o WHERE o.doc_id = k.doc_id AND o.kind IN ('assign', 'hex', 'key') AND o.a <= k.b + 240 AND o.b >= k.a - 240)))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256({_JOINED} FILTER (rank < 3), '')) AS base_sha256, {_JOINED} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN y ON y.doc_id = d.doc_id GROUP BY d.doc_id
"""

#: Part pair has all ranks, part term the first ten.
DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
o AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM o GROUP BY ALL),
m AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS n FROM n GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + 1000000000 * (coalesce(o.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
l AS (SELECT lang, term, 1 + 1000000000 * (sum(c) + 2) // (any_value(m.n) + 2 * any_value(v.v)) AS q FROM o JOIN m USING (lang) JOIN v USING (lang) GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT s.lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM s JOIN l USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
