"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '), '<|', '<\|') AS body
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM escaped GROUP BY conv_id
"""

OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS keep FROM p
), r AS (
  SELECT *, octet_length(payload) >= 1000 AND keep IS NOT NULL AND page_id IS DISTINCT FROM keep AS again FROM g
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keep END AS refers_to
FROM r
"""

OP3 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS ord
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, (rank % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s
), f AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w
), o AS (
  SELECT *, w * rest / ws <= cap AS open,
    first(CASE WHEN w * rest / ws <= cap THEN rest / 1 END IGNORE NULLS) OVER q AS level_rest,
    first(CASE WHEN w * rest / ws <= cap THEN ws / 1 END IGNORE NULLS) OVER q AS level_ws
  FROM f WINDOW q AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), t AS (
  SELECT source, source_size, rank, coalesce(w * level_rest / level_ws, cap) AS target,
    [-0.5, 0.0, 0.5][rank % 3 + 1]::DOUBLE AS slope
  FROM o
), p AS (
  SELECT d.*, t.source_size, t.target, t.slope,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, (CASE WHEN target > 0 AND mid <= target THEN 1 ELSE 0 END
    + CASE WHEN target > 0 AND mid + source_size <= target THEN 1 ELSE 0 END
    + CASE WHEN target > 0 AND mid + 2 * source_size <= target THEN 1 ELSE 0 END) AS times, mid / target AS x
  FROM p
)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken,
  CASE WHEN times = 0 THEN NULL WHEN x <= 0 THEN 0.0
    ELSE round(least(1.0, x * 2 / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + slope * x * 4, 0)))), 9) END AS first_position
FROM u
"""

OP12 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), d AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM d),
e AS (SELECT d.doc_id, n.n, unnest(d.s) AS shingle FROM d JOIN n USING (doc_id)),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common
  FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id AND x.n * 100 >= y.n * 85 AND y.n * 100 >= x.n * 85
  GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, any_value(n) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM n JOIN reach ON a = doc_id GROUP BY doc_id
"""


def _op13() -> str:
    """Costs, edits and turns of the best way to each of the four states, row by row."""
    add = lambda s, role: f"{{'c': {s}.c + 3, 'a': {s}.a || 'I', 'r': list_append({s}.r, '{role}:')}}"
    more = lambda s, cost, edit, turn: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'r': list_append({s}.r, {turn})}}"
    drop = lambda s: f"{{'c': {s}.c + 4, 'a': {s}.a || 'D', 'r': {s}.r}}"
    reroled = lambda s, role: more(s, "3 + extra", "R", f"'{role}:' || text")
    kept = lambda s, initial: more(s, f"extra + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000 END", "K", "role || ':' || text")
    return rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda s: ord(s)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM conversations
), f AS (SELECT *, xor(crc, 4294967295) % 20 AS fault FROM o),
hurt AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM f
), r AS (
  SELECT *, row_number() OVER w AS rn, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), k AS (
  SELECT conv_id, turn, role, text, rn, initial, before, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM r
), walk AS (
  SELECT conv_id, 0::BIGINT AS rn, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s0, {{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s1,
    {{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s2, {{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s3
  FROM (SELECT DISTINCT conv_id FROM k)
  UNION ALL
  SELECT conv_id, rn, {drop('e0')}, list_min([{drop('e1')}, {kept('e0', 's')}]),
    list_min([{drop('e2')}, {', '.join(f(e, x) for e in ('e0', 'e1', 'e3') for f, x in ((reroled, 'user'), (kept, 'u')))}]),
    list_min([{drop('e3')}, {reroled('e2', 'assistant')}, {kept('e2', 'a')}])
  FROM (
    SELECT conv_id, rn, role, text, initial, e0, e1, e3, e2,
      CASE fault WHEN 't' THEN 3::BIGINT WHEN '' THEN 0::BIGINT ELSE 1000000000::BIGINT END AS extra
    FROM (
      SELECT k.*, s0 AS e0, s1 AS e1, list_min([s2, {add('s0', 'user')}, {add('s1', 'user')}, {add('s3', 'user')}]) AS e2,
        list_min([s3, {add('s2', 'assistant')}, {{'c': s0.c + 6, 'a': s0.a || 'II', 'r': s0.r || ['user:', 'assistant:']}}, {{'c': s1.c + 6, 'a': s1.a || 'II', 'r': s1.r || ['user:', 'assistant:']}}]) AS e3
      FROM walk JOIN k ON walk.conv_id IS NOT DISTINCT FROM k.conv_id AND k.rn = walk.rn + 1
    )
  )
), done AS (
  SELECT conv_id, list_min([s0, s3, {add('s2', 'assistant')}, {{'c': s1.c + 6, 'a': s1.a || 'II', 'r': s1.r || ['user:', 'assistant:']}}]) AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (rn > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM k GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted ON c.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN done ON c.conv_id IS NOT DISTINCT FROM done.conv_id
"""


ORACLES = {"op1_chat_formatting": OP1, "op2_warc": OP2, "op3_exact_dedup": OP3, "op7_mixing": OP7, "op12_chosen_path": OP12, "op13_conversation_repair": _op13()}
