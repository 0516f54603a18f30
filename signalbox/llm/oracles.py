"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

#: Spans of one kind: pattern, check on the match m, score, and the words that raise and lower it.
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])'))) = 0",
    "card": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND luhn(reverse(regexp_replace(m, '[^0-9]', '', 'g')))",
    "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15",
    "ssn": "NOT regexp_matches(m, '^(000|666|9..)|-00-|-0000$')",
}
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.9, "e-?mail|contact|write", "example|noreply", True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.6, "ip|host|server|address|client", "version|release|section", True),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0.8, "card|visa|credit|debit|payment", "serial|isbn|order", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", "offset|utc|gmt", True),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", 0.8, "iban|bank|account", "serial|part", False),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social security|taxpayer", "order|serial|part", False),
)


def _pii() -> str:
    """Spans by place in the whole text; the context is the 40 code points on either side, whatever they hold."""
    # Macros can't be made in a query, so the two checks are spelled out.
    luhn = "(list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {0}[i]::INTEGER WHEN {0}[i]::INTEGER > 4 THEN 2 * {0}[i]::INTEGER - 9 ELSE 2 * {0}[i]::INTEGER END)) % 10 = 0)"
    mod = "(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({0}, 5) || left({0}, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT)), lambda r, v: CASE WHEN v >= 1000 THEN (r * 100 + v - 1000) % 97 ELSE (r * 10 + v) % 97 END) = 1)"
    found, kinds = [], []
    for number, (kind, pattern, score, up, down, base) in enumerate(_KINDS):
        if kind == "iban":  # at every place, the longest beginning up to a space that holds; not inside another
            valid = f"length(replace(p, ' ', '')) BETWEEN 15 AND 34 AND {mod.format("replace(p, ' ', '')")}"
            found.append(f"""
iban_at AS (
  SELECT doc_id, text, i - 1 AS start_at, string_split(substr(text, i, 4) || regexp_extract(substr(text, i + 4, 60), '^((?: ?[A-Z0-9]){{11,30}})'), ' ') AS parts
  FROM (SELECT doc_id, text, unnest(list_filter(range(1, length(text) - 2), lambda i: regexp_full_match(substr(text, i, 4), '[A-Z]{{2}}[0-9]{{2}}'))) AS i FROM t WHERE regexp_matches(text, '[A-Z]{{2}}[0-9]{{2}}'))),
iban_ends AS (
  SELECT doc_id, text, start_at, list_filter(list_transform(range(len(parts), 0, -1), lambda k: array_to_string(parts[1:k], ' ')), lambda p: {valid})[1] AS m FROM iban_at),
iban_found AS (
  SELECT * FROM iban_ends a WHERE m IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM iban_ends b WHERE b.doc_id = a.doc_id AND b.m IS NOT NULL AND b.start_at < a.start_at AND a.start_at < b.start_at + length(b.m)))""")
        else:
            found.append(f"""
{kind}_found AS (
  SELECT doc_id, text, m, start_at FROM (
    SELECT doc_id, text, found[i] AS m,
           list_sum(list_transform(pieces[1:i], lambda p: length(p)))::BIGINT + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0)::BIGINT AS start_at
    FROM (
      SELECT doc_id, text, found, pieces, unnest(range(1, len(found) + 1)) AS i
      FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS pieces FROM t)))
  WHERE {_VALID[kind]})""")
        kinds.append(f"""
  SELECT doc_id, {number} AS kind_order, '{kind}' AS kind, start_at, start_at + length(m) AS end_at, score FROM (
    SELECT *, greatest(0.0, least(1.0, round({score}::DOUBLE
        + CASE WHEN regexp_matches(near, '\\b({up})\\b') THEN 0.4 ELSE 0.0 END - CASE WHEN regexp_matches(near, '\\b({down})\\b') THEN 0.3 ELSE 0.0 END, 2)))::DOUBLE AS score
    FROM (SELECT *, lower(substr(text, greatest(start_at - 40, 0) + 1, least(40, start_at)) || ' ' || substr(text, start_at + length(m) + 1, 40)) AS near FROM {kind}_found)
  ){'' if base else ' WHERE score >= 0.5'}""")
    sql = ",".join(found).replace("luhn(reverse(regexp_replace(m, '[^0-9]', '', 'g')))", luhn.format("reverse(regexp_replace(m, '[^0-9]', '', 'g'))"))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {sql},
spans AS ({" UNION ALL ".join(kinds)}),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY kind_order, start_at) FILTER (kind_order < 4) AS base,
         string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY kind_order, start_at) AS spans, max(score) AS best
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
       coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(best, 0.0)::DOUBLE AS best_score
FROM t LEFT JOIN found USING (doc_id)"""


_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS er,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS et FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + length('<turn role="') + length('">') + length('</turn>') + 1)::BIGINT AS formatted_chars,
       sum(ceil(length(text) / 4.0))::BIGINT AS n_tokens
FROM e GROUP BY conv_id"""

_DECONTAMINATE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
p AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0)),
d AS (
  SELECT doc_id, i, s.size, array_to_string(words[i:i + s.size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w) JOIN (SELECT DISTINCT size FROM p) s ON i + s.size - 1 <= len(words)),
hits AS (SELECT doc_id, item_id, i, p.size FROM d JOIN p ON d.win = p.win AND d.size = p.size),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

# CRC-32 by its table; then a shortest path over the grammar's states (0 nothing, 1 after s, 2 after u, 3 after a pair).
_REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c // 256, crc.t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc),
kept AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) FROM given WHERE fault <> 0)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM kept)),
marked AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
-- Inserted turns before a row: which state they lead to. From 1 and 3 and 0 comes u, from 2 comes a.
lead_in(a, b, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2), (3, 3, 2), (2, 2, 2)),
next(a, x, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ways AS (
  SELECT m.conv_id, m.i, l.a, l.b AS b, 3 * l.k + 4 AS cost, repeat('I', l.k) || 'D' AS letter FROM marked m, lead_in l
  UNION ALL SELECT m.conv_id, m.i, l.a, n.b, 3 * l.k + CASE WHEN fault IS NULL THEN 0 ELSE 3 END, repeat('I', l.k) || 'K' FROM marked m, lead_in l, next n
  WHERE l.b = n.a AND n.x = left(m.role, 1) AND (fault IS NULL OR fault = 'truncated')
  UNION ALL SELECT m.conv_id, m.i, l.a, n.b, 3 * l.k + 3 + CASE WHEN fault IS NULL THEN 0 ELSE 3 END, repeat('I', l.k) || 'R' FROM marked m, lead_in l, next n
  WHERE l.b = n.a AND n.x <> 's' AND (fault IS NULL OR fault = 'truncated')),
parse(conv_id, i, state, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM marked
  UNION ALL
  (SELECT conv_id, i, state, best.cost, best.audit FROM (
    SELECT p.conv_id, w.i, w.b AS state, min(struct_pack(cost := p.cost + w.cost, audit := p.audit || w.letter)) AS best
    FROM parse p JOIN ways w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 AND w.a = p.state GROUP BY p.conv_id, w.i, w.b))),
won AS (
  SELECT p.conv_id, min(struct_pack(cost := p.cost + 3 * l.k, audit := p.audit || repeat('I', l.k))) AS best
  FROM parse p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN lead_in l ON l.a = p.state AND (l.b = 3 OR l.b = 0) GROUP BY p.conv_id),
letters AS (
  SELECT conv_id, j, substr(audit, j, 1) AS letter, j - len(replace(substr(audit, 1, j), 'I', '')) AS skipped
  FROM (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS j FROM won)),
turns AS (
  SELECT l.conv_id, j, letter, m.role, m.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY j) AS out,
         first_value(CASE WHEN letter = 'K' AND left(m.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY j) AS system
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = j - skipped AND letter <> 'I' WHERE letter <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM turns GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM g.conv_id"""

ORACLES = {"op1_pii": _pii(), "op3_chat": _CHAT, "op8_decontaminate": _DECONTAMINATE, "op13_repair": _REPAIR}
