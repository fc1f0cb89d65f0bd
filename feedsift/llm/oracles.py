"""Longer oracle SQL, put together from repeated pieces."""

from __future__ import annotations

#: CRC-32 of each of the 16 nibbles (reflected polynomial EDB88320); fixed values.
CRC_NIBBLE = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, a nibble at a time, the lower one of a byte first."""
    nibbles = (f"list_transform(range(0, len(hex(encode({text})))), "
               f"lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode({text})), CAST(xor(i, 1) + 1 AS INTEGER), 1)) - 1 AS BIGINT))")
    step = f"lambda c, x: xor(c >> 4, {CRC_NIBBLE}[CAST(xor(c, x) & 15 AS INTEGER) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {nibbles}), {step}))"


def _conversation() -> str:
    def paid(e: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(left({e}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({e}, 10) || '{letter}'"

    def inserts(source: str) -> str:
        once = (f"SELECT * REPLACE (least(e2, {', '.join(paid(e, '3', 'I') for e in ('e0', 'e1', 'e3'))}) AS e2, "
                f"least(e3, {paid('e2', '3', 'I')}) AS e3) FROM ")
        return f"{once}({once}({source}))"

    stays = "fault IN (0, 3)"
    extra = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"

    def kept(kind: int, *states: str) -> str:
        return ", ".join(f"CASE WHEN {stays} AND kind = {kind} THEN {paid(e, extra, 'K')} END" for e in states)

    def rerole(*states: str) -> str:
        return ", ".join(f"CASE WHEN {stays} THEN {paid(e, '3 + ' + extra, 'R')} END" for e in states)

    crc = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
f AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS d
  FROM conversations JOIN ids ON conversations.conv_id IS NOT DISTINCT FROM ids.conv_id),
g AS (SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS again FROM f WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), again) AS k, regexp_replace(text, '{space}+$', '') AS bare FROM g),
r AS (SELECT *, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind,
    CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 2
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
p AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY k) || left(role, 1) AS pair, lag(k) OVER (PARTITION BY c ORDER BY k) AS prev FROM r),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (prev IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS rows FROM p GROUP BY c),
dp AS (SELECT c, CAST(0 AS BIGINT) AS k, repeat('0', 9) AS e0, CAST(NULL AS VARCHAR) AS e1, CAST(NULL AS VARCHAR) AS e2, CAST(NULL AS VARCHAR) AS e3 FROM counts
  UNION ALL
  SELECT c, k, {paid('e0', '4', 'D')}, least({paid('e1', '4', 'D')}, {kept(0, 'e0')}),
    least({paid('e2', '4', 'D')}, {kept(1, 'e0', 'e1', 'e3')}, {rerole('e0', 'e1', 'e3')}),
    least({paid('e3', '4', 'D')}, {kept(2, 'e2')}, {rerole('e2')})
  FROM (SELECT q.c, r.k, r.kind, r.fault, e0, e1, e2, e3 FROM ({inserts('SELECT * FROM dp')}) q JOIN r ON r.c = q.c AND r.k = q.k + 1)),
best AS (SELECT q.c, least(e0, e3) AS e FROM ({inserts('SELECT * FROM dp')}) q JOIN counts ON counts.c = q.c AND counts.rows = q.k),
audit AS (SELECT c, CAST(left(e, 9) AS BIGINT) AS cost, substr(e, 10) AS audit FROM best),
walk AS (SELECT c, 0 AS i, CAST(0 AS BIGINT) AS k, 0 AS state, CAST(NULL AS VARCHAR) AS out FROM audit
  UNION ALL
  SELECT c, i + 1, k + CASE WHEN x = 'I' THEN 0 ELSE 1 END,
    CASE WHEN x = 'D' THEN state WHEN x = 'K' THEN CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
    CASE WHEN x = 'D' THEN out ELSE coalesce(out || chr(10), '') ||
      CASE WHEN x = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END END
  FROM (SELECT w.c, w.i, w.k, w.state, w.out, substr(a.audit, w.i + 1, 1) AS x, r.kind, r.role, r.text
    FROM walk w JOIN audit a ON a.c = w.c AND w.i < length(a.audit) LEFT JOIN r ON r.c = w.c AND r.k = w.k + 1)),
done AS (SELECT w.c, out FROM walk w JOIN audit a ON a.c = w.c AND w.i = length(a.audit))
SELECT conv_id, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))},
  coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) LEFT JOIN audit USING (c) LEFT JOIN done USING (c)
"""


CONVERSATION = _conversation()


SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents) WHERE length(run) >= 7),
hashed AS (SELECT run, n, {crc32_sql("doc || ':' || run")} AS h FROM (SELECT doc, run, count(*) AS n FROM runs GROUP BY doc, run)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * words.n THEN near END AS form,
    CASE WHEN near_n >= 10 * words.n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
