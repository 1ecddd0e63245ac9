"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
_ASSIGN = rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Matches with their places: what stands before a match is the parts and matches before it."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {place} AS place, k,
           list_sum(list_transform(parts[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS a,
           length(hits[k]) AS n
    FROM (SELECT doc_id, hits, parts, unnest(range(1, len(hits) + 1)) AS k
          FROM (SELECT doc_id, regexp_extract_all(x, '{pattern}') AS hits, string_split_regex(x, '{pattern}') AS parts FROM t))
    WHERE length(regexp_extract(hits[k], '{pattern}', {group})) >= {least}"""


ORACLES["op4_secret_scans"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS ({_spans("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans("hex", 2, "[0-9a-f]{24,}", 0, 24)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(concat_ws(':', kind, a::BIGINT, (a + n)::BIGINT), ',' ORDER BY a, place) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""

ORACLES["op8_kd_tree_top_k"] = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
      FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op6_minhash_bottom_k"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS v FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""

# Bytes as hexadecimal text, two characters each, in blocks: taking a part of a long text costs its length.
ORACLES["op1_suffix_array_dedup"] = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, k, x[2000 * k + 1:2000 * k + 2398] AS y, len(x) // 2 AS n FROM (SELECT r, x, unnest(range(0, len(x) // 2000 + 1)) AS k FROM t WHERE len(x) >= 400)),
s AS (SELECT r, y, unnest(range(1000 * k, least(1000 * k + 1000, n - 199))) AS p FROM b),
h AS (SELECT r, p, md5(y[2 * (p % 1000) + 1:2 * (p % 1000) + 400]) AS h FROM s),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM h SEMI JOIN d USING (h)),
g AS (SELECT r, p, sum((q IS NULL OR p > q + 200)::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM c),
u AS (SELECT r, k, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, k),
v AS (SELECT r, k, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY k) AS z FROM u),
w AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(x[2 * z + 1:2 * a], '' ORDER BY k) AS y FROM v JOIN t USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN w.r IS NULL THEN x ELSE y || x[2 * last + 1:] END)) AS kept_sha256
FROM t LEFT JOIN w USING (r)
"""

ORACLES["op12_phrase_collocations"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda y: y <> '') AS ws FROM t),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest(range(1, 6)) AS k FROM p))),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score, q.j
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) q JOIN c USING (lang, phrase) JOIN n ON n.lang = c.lang
      JOIN f x ON x.lang = q.lang AND x.phrase = array_to_string(q.ws[1:q.j], ' ') JOIN f y ON y.lang = q.lang AND y.phrase = array_to_string(q.ws[q.j + 1:], ' ')),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM s),
z AS (SELECT DISTINCT c.lang, array_to_string(c.ws[i:i + k2 - 1], ' ') AS phrase, c.a AS longer
      FROM (SELECT *, unnest(range(1, k - k2 + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS k2 FROM c)) c),
o AS (SELECT m.* FROM m WHERE best = 1 AND NOT EXISTS (SELECT 1 FROM z WHERE z.lang = m.lang AND z.phrase = m.phrase AND 100 * z.longer >= 100 * m.a)),
e AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM e WHERE rank <= 2000
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op13_block_max_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
p AS (SELECT r, doc_id, len AS n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS len, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, c.n),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * c.n) // c.l))))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
