"""DuckDB SQL of the operators on secrets and on the structure of conversations."""

from __future__ import annotations

import re

from .secret_scan import ACCESS, ALLOWED, ASSIGN, CLASSES, HEX, KINDS, SHORTEST, CharacterClass


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def either_case(pattern: str) -> str:
    """A pattern of (?i:...) with both cases of each ASCII letter spelled out, as other engines fold more than those."""
    spell = lambda m: re.sub("[a-z]", lambda x: f"[{x[0].upper()}{x[0]}]", m[1])
    return re.sub(r"\(\?i:(.*?)\)", spell, pattern)


def crc(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295)"


def found(kind: str, pattern: str) -> str:
    p = quoted(either_case(pattern))
    return f"""m_{kind} AS (SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits FROM d WHERE regexp_matches(text, {p})),
f_{kind} AS (SELECT doc_id, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, hits[i] AS found FROM m_{kind}, unnest(range(1, len(hits) + 1)) t(i))"""


def swept(c: CharacterClass) -> str:
    no = "".join(f" AND NOT regexp_matches(found, {quoted(p)})" for p in ALLOWED)
    piece = f"substr({'lower(found)' if c.fold else 'found'}, j, {c.window})"
    return f"""w_{c.kind} AS (SELECT doc_id, start, j, {piece} AS w FROM f_{c.kind}, unnest(range(1, length(found) - {c.window} + 2)) t(j) WHERE true{no}),
h_{c.kind} AS (SELECT doc_id, start, j FROM w_{c.kind} WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda x: {c.table}[({c.window} - length(replace(w, x, '')) + 1)::INT])) <= {c.most}),
i_{c.kind} AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY j) AS island FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id, start ORDER BY j) <= {c.window} THEN 0 ELSE 1 END AS fresh FROM h_{c.kind})),
s_{c.kind} AS (SELECT doc_id, {quoted(c.kind)} AS kind, {KINDS.index(c.kind)} AS rank, start + min(j) - 1 AS start, start + max(j) - 1 + {c.window} AS stop FROM i_{c.kind} GROUP BY doc_id, start, island)"""


LENGTHS = {"assign": f"length(regexp_extract(found, {quoted(either_case(ASSIGN))}, 2))", "access": "length(found)", "hex": "length(found)"}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX[:-1] + "{%d,}" % SHORTEST["hex"]}
BASES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {KINDS.index(k)} AS rank, start, start + length(found) AS stop FROM f_{k} WHERE {LENGTHS[k]} >= {SHORTEST[k]}" for k in SHORTEST)
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(found(k, p) for k, p in PATTERNS.items())},
base AS ({BASES}),
{", ".join(found(c.kind, c.pattern) for c in CLASSES)},
{", ".join(swept(c) for c in CLASSES)},
more AS ({" UNION ALL ".join(f"SELECT * FROM s_{c.kind}" for c in CLASSES)}),
added AS (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start <= m.start AND m.stop <= b.stop)),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM base GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(a.spans, '')) AS base_sha256, coalesce(b.spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN b ON d.doc_id = b.doc_id"""

TRIE = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 1 AS part, pos, role, text FROM c JOIN o ON o.conv_id = c.base AND pos <= h UNION ALL SELECT o.conv_id, 2, pos, role, text FROM o JOIN c ON o.conv_id = c.conv_id WHERE pos > h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, sha256(strlen(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, depth, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(words) AS words, count(*) AS n_convs FROM p GROUP BY key),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN l USING (conv_id, depth) GROUP BY key),
kids AS (SELECT substr(key, 1, (depth - 1) * 64) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (key)),
sums AS (SELECT substr(key, 1, g * 64) AS key, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM x, unnest(range(0, depth + 1)) t(g) GROUP BY 1)
SELECT x.conv_id, x.depth, m.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM x JOIN sums USING (key) LEFT JOIN e USING (key) LEFT JOIN n m ON x.depth > 0 AND m.key = substr(x.key, 1, (x.depth - 1) * 64)"""

#: A way is one string: its cost in six digits, then its audit; the least string is the cheapest way, and the first in ASCII order of those.
NEVER = "'900000'"


def then(before: str, cost: str, letter: str) -> str:
    return f"(lpad((left({before}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({before}, 7) || '{letter}')"


def least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def kept(state: str, initial: str) -> str:
    return f"CASE WHEN c = '{initial}' AND NOT must THEN {then(state, 'short', 'K')} ELSE {NEVER} END"


def moved(state: str) -> str:
    return f"CASE WHEN must THEN {NEVER} ELSE {then(state, '3 + short', 'R')} END"


STEP = f"""SELECT conv_id, i, n, s, u, {least("a", then("u", "3", "I"))} AS a FROM (SELECT conv_id, i, n, s, {least("u", then("n", "3", "I"), then("s", "3", "I"), then("a", "3", "I"))} AS u, a FROM
(SELECT conv_id, i, {then("n", "4", "D")} AS n, {least(then("s", "4", "D"), kept("n", "s"))} AS s, {least(then("u", "4", "D"), *[f(q, *x) for q in "nsa" for f, x in ((kept, "u"), (moved, ""))])} AS u, {least(then("a", "4", "D"), kept("u", "a"), moved("u"))} AS a
FROM (SELECT w.conv_id, w.i + 1 AS i, w.n, w.s, w.u, w.a, left(role, 1) AS c, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS short FROM w JOIN q ON q.conv_id = w.conv_id AND q.i = w.i + 1)))"""

REPAIR = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k FROM src, unnest(range(0, CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) t(k)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS seen FROM dam),
q AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM num),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE prev || '|' || left(role, 1) NOT IN ('s|u', 'u|a', 'a|u')) AS illegal, max(i) AS rows_ FROM q GROUP BY conv_id),
w AS (SELECT conv_id, 0::BIGINT AS i, '000000' AS n, {NEVER} AS s, '000003I' AS u, '000006II' AS a FROM (SELECT DISTINCT conv_id FROM src) UNION ALL {STEP}),
best AS (SELECT w.conv_id, {least("n", "a")} AS way FROM w LEFT JOIN stats USING (conv_id) WHERE w.i = coalesce(rows_, 0)),
let AS (SELECT conv_id, p, substr(way, p + 6, 1) AS letter, length(replace(substr(way, 7, p), 'I', '')) AS i FROM best, unnest(range(1, length(way) - 5)) t(p)),
kep AS (SELECT let.conv_id, p, letter, role, text, row_number() OVER (PARTITION BY let.conv_id ORDER BY p) AS o, first(letter = 'K' AND left(role, 1) = 's') OVER (PARTITION BY let.conv_id ORDER BY p) AS led FROM let LEFT JOIN q ON q.conv_id = let.conv_id AND q.i = let.i WHERE letter <> 'D'),
told AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said FROM kep GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, left(way, 6)::BIGINT AS cost, substr(way, 7) AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM best LEFT JOIN stats USING (conv_id) LEFT JOIN told USING (conv_id)"""
