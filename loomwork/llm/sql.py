"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# A document's words are numbered; windows of 10 words are compared as joined strings.
OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents)
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM d, lengths, unnest(range(1, len(w) - k + 2)) AS u(i)
), hit AS (SELECT doc_id, pos.k, i, item FROM pos JOIN win ON win.g = pos.g AND win.k = pos.k),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""

# The template's length follows from the turns: heads, separators and ends around escaped texts.
OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), b AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN same THEN 10 ELSE 12 + length(role) + 1 + 11 END) AS BIGINT) AS formatted_chars,
       true AS mask_ok
FROM b GROUP BY conv_id
"""

OP7 = r"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars, 0.5) ELSE 0 END AS weight FROM s),
r AS (SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * sum(chars) OVER () / chars ELSE 1 END AS rate FROM w),
m AS (SELECT source, greatest(1, ceil(rate / 64))::INT AS draws, rate / greatest(1, ceil(rate / 64)) AS mean FROM r),
c AS (
  SELECT source, draws, list_transform(range(0, 161), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1))))) AS cdf FROM m
), d AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, source, text) AS nth,
         to_json({'doc_id': doc_id, 'source': source, 'text': md5(text)})::VARCHAR AS row
  FROM documents
), u AS (
  SELECT doc_id, d.source, text, row, nth, draws, cdf, list_transform(range(1, draws + 1), lambda j: (('0x' || substr(md5('mix:' || row || ':' || nth || ':' || j), 1, 12))::BIGINT + 0.5) / 281474976710656.0) AS us
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), n AS (SELECT doc_id, source, text, row, nth, list_sum(list_transform(us, lambda x: len(list_filter(cdf, lambda p: p < x))))::BIGINT AS copies FROM u)
SELECT doc_id, source, text, copy_no::INT AS copy_no, md5('mix-order:' || row || ':' || nth || ':' || copy_no) AS shuffle_key
FROM n, unnest(range(1, copies + 1)) AS e(copy_no)
"""


def _repair() -> str:
    """The cheapest edits by a recursion from the last row to the first: of the four states that roles may end in, the
    least (cost, letters, text) from there on. A piece of the text begins with a line feed."""
    state = {"n": 1, "s": 2, "u": 3, "a": 4}
    follows = {"n": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    entry = lambda cost, letters, text: f"{{'c': {cost}, 'a': {letters}, 't': {text}}}"
    then = lambda cost, letter, piece, to: entry(f"{cost} + {to}.c", f"'{letter}' || {to}.a", f"{piece} || {to}.t")
    behind = {x: f"b[{i}]" for x, i in state.items()}
    says = "chr(10) || role || ':' || text"
    kept = {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    used = []
    for x in state:
        options = [then(4, "D", "''", behind[x]), f"CASE WHEN stays THEN {then('3 + extra', 'R', f'chr(10) || {chr(39)}{name[follows[x]]}:{chr(39)} || text', behind[follows[x]])} END"]
        options += [f"CASE WHEN stays AND r = '{r}' THEN {then('extra', 'K', says, behind[to])} END" for r, to in kept[x].items()]
        used.append(f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL)) AS use_{x}")
    best = []
    for x in state:
        one, two = follows[x], follows[follows[x]]
        piece = lambda k: f"chr(10) || '{name[k]}:'"
        twice = entry(f"6 + use_{two}.c", f"'II' || use_{two}.a", f"{piece(one)} || {piece(two)} || use_{two}.t")
        best.append(f"list_min([use_{x}, {then(3, 'I', piece(one), f'use_{one}')}, {twice}])")
    end = ", ".join([entry(0, "''", "''"), entry(6, "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), entry(3, "'I'", "chr(10) || 'assistant:'"), entry(0, "''", "''")])
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0 END))) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda k: ascii(k)::UBIGINT)), lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295) % 20 AS f FROM keyed, crc
), rows_after AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) WHERE f <> 0
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER w AS i, left(role, 1) AS r, lag(left(role, 1)) OVER w AS r_before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM rows_after WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), met AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM placed),
judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM met
), faults AS (SELECT *, NOT blank AND NOT duplicate AS stays, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM judged),
counts AS (
  SELECT conv_id, c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (r_before IS NOT NULL AND r_before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id, c
), rec AS (
  SELECT c, n + 1 AS i, [{end}] AS b FROM counts
  UNION ALL
  SELECT c, i, [{', '.join(best)}] FROM (SELECT f.c, f.i, {', '.join(used)} FROM rec JOIN faults f ON f.c = rec.c AND f.i = rec.i - 1)
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b[1].c, 0)::BIGINT AS cost, coalesce(b[1].a, '') AS audit, sha256(coalesce(substr(b[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rec ON rec.c = counts.c AND rec.i = 1
"""


OP11 = _repair()


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3, "op4_warc_index": OP4, "op6_chat_format": OP6, "op7_mix_sources": OP7, "op11_conversation_repair": OP11}
