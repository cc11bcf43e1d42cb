"""SQL for DuckDB that gives the rows of op11 to op13, independent of the operators but for constants."""

from __future__ import annotations

from quillon.llm.resample import CRC
from quillon.llm.turn_repair import MOVES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(blob: str) -> str:
    """SQL for the CRC-32 of a blob: one step of the byte-wise table a byte, from its hexadecimal digits."""
    data = f"hex({blob})"
    steps = f"list_transform(range(len({data}) // 2), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({steps}, lambda c, b: xor({CRC.tolist()}[(xor(c, b) & 255) + 1]::BIGINT, c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


def op11() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id FROM g JOIN (SELECT doc_id, min(node) AS low FROM r GROUP BY doc_id) USING (doc_id)"""


def op12() -> str:
    return rf"""
WITH w AS (SELECT 0 AS part, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT part, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) AS x FROM w),
u AS MATERIALIZED (SELECT x, {crc32("encode(x)")} % 10000 AS bucket FROM (SELECT DISTINCT x FROM f)),
c AS (SELECT bucket, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM f JOIN u USING (x) GROUP BY bucket),
gn AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
p AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN u USING (x) JOIN gn USING (bucket) WHERE part = 0 GROUP BY doc_id),
q AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN p USING (doc_id) WHERE part = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM k"""


def op13() -> str:
    moves = ", ".join(str((m["initial"], m["fault"], m["f"], m["t"], m["cost"], m["audit"])) for m in MOVES.to_pylist())
    last = r"right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1)"
    return rf"""
WITH RECURSIVE moves(initial, fault, f, t, cost, audit) AS (VALUES {moves}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), again) - 1 AS k FROM d),
b AS (SELECT *, {last} AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth, left(role, 1) AS one FROM o),
r AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE WHEN one IN ('s', 'u', 'a') THEN one ELSE 'x' END AS initial, one || lead(one) OVER (PARTITION BY conv_id ORDER BY k) AS pair FROM b),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS t, 0::BIGINT AS cost, '' AS audit FROM r
  UNION ALL SELECT conv_id, k + 1, t, best.cost, best.audit FROM (SELECT r.conv_id, r.k, moves.t, min({{'cost': dp.cost + moves.cost, 'audit': dp.audit || moves.audit}}) AS best
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.k = dp.k JOIN moves ON moves.initial = r.initial AND moves.fault = r.fault AND moves.f = dp.t GROUP BY ALL)),
e AS (SELECT conv_id, min({{'cost': cost + CASE t WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': audit || CASE t WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS best FROM dp JOIN (SELECT conv_id, count(*) AS n FROM r GROUP BY 1) z USING (conv_id) WHERE k = n GROUP BY conv_id),
v AS (SELECT conv_id, best.audit AS audit, 1 AS p, 0 AS k, '' AS state, '' AS said FROM e
  UNION ALL SELECT v.conv_id, audit, p + 1, v.k + (audit[p] <> 'I')::INT, CASE WHEN audit[p] = 'D' THEN state WHEN audit[p] = 'K' THEN one WHEN state = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN audit[p] = 'D' THEN said ELSE said || CASE WHEN said = '' THEN '' ELSE chr(10) END || CASE WHEN audit[p] = 'K' THEN role WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN audit[p] = 'I' THEN '' ELSE text END END
  FROM v LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.k = v.k WHERE p <= length(audit)),
x AS (SELECT conv_id, sha256(said) AS repaired_sha256 FROM v WHERE p = length(audit) + 1),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM i.conv_id"""
