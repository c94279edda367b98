"""The operators' queries in DuckDB's SQL, where it can express them: the definitions, pair by pair and window by window."""

from __future__ import annotations

from scrivana.llm import secrets
from scrivana.llm.exact_dedup import OP3_SQL
from scrivana.llm.near_dedup import OP4_THRESHOLD, SHINGLE
from scrivana.llm.suffix_dedup import LENGTH

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links between any two documents that share a shingle; a component is what is reached over links.
OP4_SQL = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {OP4_THRESHOLD} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, ways.b FROM r JOIN ways ON r.b = ways.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, b) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept FROM n LEFT JOIN c ON a = doc_id"""

#: Every string of LENGTH bytes, as hexadecimal text; pieces of 1000 bytes keep the cutting linear.
OP8_SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, {2 * (1000 + LENGTH - 1)}) AS piece FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 1000)) AS pos FROM h)),
w AS (SELECT doc_id, pos + o AS pos, md5_number(substr(piece, 2 * o + 1, {2 * LENGTH})) AS s
      FROM (SELECT doc_id, pos, piece, unnest(range(0, least(1000, length(piece) // 2 - {LENGTH - 1}))) AS o FROM p WHERE length(piece) >= {2 * LENGTH})),
g AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS nth FROM w) WHERE nth > 1),
b AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {LENGTH} THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM b),
spans AS (SELECT doc_id, k, min(pos) AS s, max(pos) + {LENGTH} AS e FROM i GROUP BY ALL),
edges AS (SELECT doc_id, k, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, s AS z FROM spans
          UNION ALL SELECT doc_id, 1000000000000, coalesce((SELECT max(e) FROM spans WHERE spans.doc_id = h.doc_id), 0), length(x) // 2 FROM h),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY k) AS kept FROM edges JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, (SELECT coalesce(sum(e - s), 0)::BIGINT FROM spans WHERE spans.doc_id = h.doc_id) AS n_removed,
       (SELECT count(*) FROM spans WHERE spans.doc_id = h.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN kept USING (doc_id)"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = secrets.ASSIGN
for _word in ("password", "passwd", "secret", "token", "api"):
    _ASSIGN = _ASSIGN.replace(_word, _either_case(_word))
_ASSIGN = _ASSIGN.replace("_?key", "_?" + _either_case("key")).replace("(?i:", "(?:").replace("'", "''")


def _matches(kind: str, pattern: str, group: int = 0) -> str:
    """Rows of a kind's matches: a match starts where the texts between and the matches before it end."""
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    return rf"""
  SELECT doc_id, source, '{kind}' AS kind, v[i] AS v, ({length("g[1 : i]")} + {length("m[1 : i - 1]")})::BIGINT AS s, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, regexp_split_to_array(t, '{pattern}') AS g FROM d))"""


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
assign AS (SELECT * FROM ({_matches("assign", _ASSIGN, 2)}) WHERE length(v) >= {secrets.ASSIGN_LEAST}),
access AS ({_matches("access", secrets.ACCESS)}),
hexes AS ({_matches("hex", secrets.HEX)}),
base AS (SELECT *, 0 AS rank FROM assign UNION ALL SELECT *, 1 FROM access UNION ALL SELECT *, 2 FROM hexes),
found AS ({_matches("owned", secrets.CREDENTIAL)}),
more AS (SELECT *, 3 AS rank FROM found f WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {secrets.DISTINCT}
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.s < f.s + f.n AND f.s < b.s + b.n)),
held AS (SELECT * FROM base UNION ALL SELECT * FROM more),
own AS (SELECT v FROM (SELECT DISTINCT doc_id, source, v FROM held) GROUP BY v
        HAVING count(DISTINCT coalesce('x' || source, '')) <= {secrets.MAX_OWNERS} AND count(*) <= {secrets.MAX_REPOSITORIES}),
spans AS (SELECT *, v IN (SELECT v FROM own) AS specific, kind || ':' || s || ':' || (s + n) AS written FROM held)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(written, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(written, ',' ORDER BY s, rank) FILTER (rank < 3 OR specific), '') AS spans,
       count(*) FILTER (rank < 3 AND specific) AS n_specific, count(*) FILTER (rank < 3 AND NOT specific) AS n_copied
FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""

SQL = {"op3_exact_dedup": OP3_SQL, "op4_minhash": OP4_SQL, "op8_suffix_array": OP8_SQL, "op9_secrets": OP9_SQL}
