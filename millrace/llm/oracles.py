"""SQL of the operators on shingle sets, spelling variants and conversations."""

from __future__ import annotations

BLANKS = r"[\x20\x09-\x0D]"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The table of the byte-wise CRC-32 (reflected polynomial 0xEDB88320), one list.
CRC_TABLE = """tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc32(text: str) -> str:
    """CRC-32 of a text expression; ``tab`` has to be joined."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


MINHASH = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({LOWER}, '{BLANKS}+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, hash(array_to_string(list_slice(ws, i, i + 4), ' ')) AS g, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS m
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.m = b.m AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT reach.a AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w LEFT JOIN n USING (r) JOIN c USING (r)"""

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
u AS MATERIALIZED (SELECT id, run, count(*) AS n FROM t WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM u, tab),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b, b.n AS nb FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
g AS (SELECT a AS word, count(*) AS n_near, max(nb) AS top FROM p GROUP BY 1),
f AS (SELECT a AS word, min(b) AS form, any_value(top) AS form_n, any_value(n_near) AS n_near FROM p JOIN g ON g.word = p.a AND p.nb = g.top GROUP BY 1),
k AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN f USING (word)),
chain AS (SELECT word, word AS tip, 0 AS depth FROM k UNION ALL SELECT chain.word, k.form, depth + 1 FROM chain JOIN k ON k.word = chain.tip WHERE k.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM k JOIN (SELECT word, max_by(tip, depth) AS root FROM chain GROUP BY 1) USING (word)"""


def _plus(weight: str, cost: str, letter: str) -> str:
    return f"(lpad(CAST(CAST(substr({weight}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({weight}, 10) || '{letter}')"


def _least(*values: str) -> str:
    return f"least({', '.join(values)})"


_U = _least("vu", _plus("v0", "3", "I"), _plus("vs", "3", "I"), _plus("va", "3", "I"))
_A = _least("va", _plus("iu", "3", "I"))
_FROM = ("v0", "vs", "ia")
_STEP = f"""SELECT conv_id, i, {_plus("v0", "4", "D")} AS v0,
  {_least(_plus("vs", "4", "D"), f"CASE WHEN NOT gone AND first = 's' THEN {_plus('v0', 'extra', 'K')} END")} AS vs,
  {_least(_plus("iu", "4", "D"), *(f"CASE WHEN NOT gone THEN {_plus(v, '3 + extra', 'R')} END" for v in _FROM), *(f"CASE WHEN NOT gone AND first = 'u' THEN {_plus(v, 'extra', 'K')} END" for v in _FROM))} AS vu,
  {_least(_plus("ia", "4", "D"), f"CASE WHEN NOT gone THEN {_plus('iu', '3 + extra', 'R')} END", f"CASE WHEN NOT gone AND first = 'a' THEN {_plus('iu', 'extra', 'K')} END")} AS va"""

CONVERSATIONS = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
m AS (SELECT conv_id, turn, role, text, {crc32("place")} % 20 AS kind FROM r, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS nth FROM m WHERE kind <> 0),
o AS (SELECT *, substr(role, 1, 1) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i FROM d),
q AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair FROM o),
f AS MATERIALIZED (SELECT *, body = '' AS empty, body <> '' AND again AS copy, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
        body = '' OR again AS gone, CASE WHEN body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra FROM q),
p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS vs, CAST(NULL AS VARCHAR) AS vu, CAST(NULL AS VARCHAR) AS va FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  {_STEP} FROM (SELECT *, {_A} AS ia FROM (SELECT f.conv_id, f.i, f.first, f.gone, f.extra, v0, vs, va, {_U} AS iu FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1))),
z AS (SELECT conv_id, least(v0, {_A}) AS best FROM (SELECT conv_id, i, v0, va, {_U} AS iu, max(i) OVER (PARTITION BY conv_id) AS last FROM p) WHERE i = last),
y AS MATERIALIZED (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM z),
a AS (SELECT conv_id, pos, substr(audit, CAST(pos AS BIGINT), 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM y)),
b AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM a),
c AS (SELECT b.conv_id, b.pos, letter, f.role, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text, letter = 'K' AND f.first = 's' AS head,
        row_number() OVER (PARTITION BY b.conv_id ORDER BY b.pos) AS nth
      FROM b LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i WHERE letter <> 'D'),
e AS (SELECT *, nth - max(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS k FROM c),
g AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole FROM e GROUP BY 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank, count(*) FILTER (copy) AS duplicate,
        count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT y.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM y LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM y.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM y.conv_id"""
