"""DuckDB's SQL for the queries over conversations."""

#: crc32 of the key, bit by bit: each byte is added before the first of its eight steps.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(key)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(key[i // 8 + 1])::BIGINT ELSE 0 END)), "
    "lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
)
_NEVER = 1 << 40


def _add(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {edit}}}"


def _stays(state: str, initial: str) -> str:
    return _add(state, f"cut + CASE WHEN ini = '{initial}' THEN 0 ELSE 2 END", f"CASE WHEN ini = '{initial}' THEN 'K' ELSE 'R' END")


REPAIRED = rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
 m AS (SELECT *, {_CRC} % 20 AS kind FROM k),
 d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM m WHERE kind <> 0),
 n AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
 f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
 g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
 t AS (SELECT conv_id, count(*) AS rows, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
 r(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {{'c': {_NEVER}::BIGINT, 'a': ''}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 4::BIGINT, 'a': 'II'}} FROM g
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, least(n3, {_add('m2', '2', "'I'")}) FROM (
   SELECT *, least(n2, {_add('n0', '2', "'I'")}, {_add('n1', '2', "'I'")}, {_add('n3', '2', "'I'")}) AS m2 FROM (
    SELECT r.conv_id, g.i, {_add('s0', '3', "'D'")} AS n0,
     CASE WHEN NOT gone AND ini = 's' THEN least({_add('s1', '3', "'D'")}, {_add('s0', 'cut', "'K'")}) ELSE {_add('s1', '3', "'D'")} END AS n1,
     CASE WHEN gone THEN {_add('s2', '3', "'D'")} ELSE least({_add('s2', '3', "'D'")}, {_stays('s0', 'u')}, {_stays('s1', 'u')}, {_stays('s3', 'u')}) END AS n2,
     CASE WHEN gone THEN {_add('s3', '3', "'D'")} ELSE least({_add('s3', '3', "'D'")}, {_stays('s2', 'a')}) END AS n3
    FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1))),
 b AS (SELECT t.*, least(s0, s3).c AS cost, least(s0, s3).a AS audit FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.rows),
 e AS (SELECT conv_id, pos, audit[pos] AS edit, pos - length(replace(audit[1:pos], 'I', '')) AS inserts FROM b, range(1, 100000) p(pos) WHERE pos <= length(audit)),
 o AS (SELECT e.conv_id, pos, edit, g.role, coalesce(g.text, '') AS text, row_number() OVER w - 1 AS place, first_value(edit = 'K' AND g.ini = 's') OVER w AS led FROM e LEFT JOIN g ON edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = pos - inserts WHERE edit <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY pos)),
 q AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' AND role IS NOT NULL THEN role WHEN (place + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS whole FROM o GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id"""

#: What escapes add to a text: a character for each backslash, `<` of a closing mark and `#` that two more follow.
_MORE = "len(regexp_extract_all({0}, '\\\\')) + len(regexp_extract_all({0}, '</turn>')) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"

FORMATTED = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 l AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole, count(*) AS n,
  sum(14 + length(role) + length(text) + {_MORE.format('text')} + {_MORE.format('role')} + len(regexp_extract_all(role, ':'))) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM l"""
