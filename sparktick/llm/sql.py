"""SQL (DuckDB) of the operators that SQL can express, written by other means than the operators use."""

from __future__ import annotations

# CRC-32 of a text of code points below 2048, byte by byte, from a table of 256 remainders.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def crc32(text: str, table: str = "crc_table.t") -> str:
    code = f"unicode(substr({text}, j, 1))"
    octets = f"CASE WHEN {code} < 128 THEN [{code}::BIGINT] ELSE [(192 | ({code} >> 6))::BIGINT, (128 | ({code} & 63))::BIGINT] END"
    octets = f"flatten(list_transform(range(1, length({text}) + 1), lambda j: {octets}))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _add(value: str, cost: str, edit: str) -> str:
    return f"(lpad((substr({value}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || substr({value}, 10))"


def _backward() -> str:
    """Dynamic programming from the last row: for each state, cost (nine digits) and audit of the cheapest completion."""
    onward = {1: 3, 2: 3, 3: 4, 4: 3}  # nothing, system, user, assistant; lists count from 1
    more = "(CASE WHEN x[3] = 't' THEN 3 ELSE 0 END)"
    kept = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    edits = []
    for state, to in onward.items():
        keep = "".join(f" WHEN x[2] = '{role}' THEN {_add(f'acc[{end}]', more, 'K')}" for role, end in kept[state].items())
        free = f"least({_add(f'acc[{to}]', f'3 + {more}', 'R')}, CASE{keep} END)"
        edits.append(f"least({_add(f'acc[{state}]', '4', 'D')}, CASE WHEN x[3] NOT IN ('b', 'd') THEN {free} END)")
    inserts = [
        f"least(acc[{s}], {_add(f'acc[{to}]', '3', 'I')}, {_add(_add(f'acc[{onward[to]}]', '3', 'I'), '3', 'I')})" for s, to in onward.items()
    ]
    end = "['000000000', '000000006II', '000000003I', '000000000']"
    return f"list_reduce(steps, lambda acc, x: CASE WHEN x[1] = 'insert' THEN [{', '.join(inserts)}] ELSE [{', '.join(edits)}] END, {end})"


OP11 = f"""WITH {CRC_TABLE},
source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
judged AS (SELECT source.*, {crc32('k')} % 20 AS kind FROM source, crc_table),
present AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM judged WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM present),
faulty AS (
  SELECT conv_id, turn, role, text, p, substr(role, 1, 1) AS initial,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
              WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault
  FROM placed),
stepped AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         flatten(list([['edit', initial, fault], ['insert', '', '']] ORDER BY p DESC)) AS steps
  FROM faulty GROUP BY conv_id),
solved AS (SELECT *, {_backward()}[1] AS best FROM stepped),
audits AS (SELECT *, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM solved),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM audits),
edits AS (
  SELECT conv_id, j, substr(audit, j, 1) AS edit, count(*) FILTER (substr(audit, j, 1) <> 'I') OVER w AS p,
         count(*) FILTER (substr(audit, j, 1) <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
said AS (
  SELECT e.conv_id, e.o, e.edit, f.role, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text,
         max(CASE WHEN e.o = 1 AND e.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS lead
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.p = e.p WHERE e.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                             chr(10) ORDER BY o) AS whole FROM said GROUP BY conv_id)
SELECT c.conv_id, coalesce(a.gaps, 0)::BIGINT AS gaps, coalesce(a.blank, 0)::BIGINT AS blank, coalesce(a.duplicate, 0)::BIGINT AS duplicate,
       coalesce(a.truncated, 0)::BIGINT AS truncated, coalesce(a.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost,
       coalesce(a.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""

# Letters beyond A-Z as one-byte stand-ins, so that byte-wise edit distances count code points.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_STAND_INS = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'\"")[:64]

OP13 = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
each AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY run, doc_id),
hashed AS (SELECT run, n, {crc32('k')} AS h FROM each, crc_table),
results AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n, translate(word, '{_ACCENTED}', '{_STAND_INS}') AS plain FROM results WHERE length(word) >= 7
  GROUP BY word HAVING sum(n) >= 2),
shortened AS (
  SELECT word, n, plain, plain AS part FROM words
  UNION SELECT word, n, plain, substr(plain, 1, j - 1) || substr(plain, j + 1) FROM (SELECT *, unnest(range(1, length(plain) + 1)) AS j FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM shortened a JOIN shortened b ON a.part = b.part AND a.word <> b.word
  WHERE levenshtein(a.plain, b.plain) = 1),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, struct_pack(less := -other_n, other := other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
followed AS (
  SELECT word, word AS root FROM known UNION ALL SELECT f.word, k.form FROM followed f JOIN known k ON k.word = f.root WHERE k.form IS NOT NULL)
SELECT k.word, k.form, f.root, k.n, k.n_near, k.form_n FROM known k
JOIN (SELECT f.word, f.root FROM followed f JOIN known e ON e.word = f.root WHERE e.form IS NULL) f ON f.word = k.word"""
