"""SQL of operator 13: the same search as a recursion over rows, one string a place.

A survivor is its cost in nine digits, its edits, a separator and its text, so the
least string is the cheapest survivor with the least edits.  CRC-32 is computed
from its polynomial.
"""

from __future__ import annotations


def _grow(state: str, cost: str, edit: str, line: str | None = None) -> str:
    text = f"substr({state}, strpos({state}, chr(1)) + 1)"
    joined = text if line is None else f"(CASE WHEN {text} = '' THEN {line} ELSE {text} || chr(10) || {line} END)"
    head = f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr(split_part({state}, chr(1), 1), 10)"
    return f"({head} || '{edit}' || chr(1) || {joined})"


def _when(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


def _inserted(before: str) -> str:
    user = f"least(u, {', '.join(_grow(p, '3', 'I', chr(39) + 'user:' + chr(39)) for p in ('n', 's', 'a'))})"
    assistant = f"least(a, {_grow('u', '3', 'I', chr(39) + 'assistant:' + chr(39))})"
    return f"SELECT conv_id, i, n, s, u, {assistant} AS a FROM (SELECT conv_id, i, n, s, {user} AS u, a FROM ({before}))"


def _row() -> str:
    free = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'"
    extra = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    kept = "role || ':' || text"
    keep = lambda states, initial: [_when(f"{free} AND initial = '{initial}'", _grow(f"w.{p}", extra, "K", kept)) for p in states]
    rerole = lambda states, role: [_when(free, _grow(f"w.{p}", f"3 + {extra}", "R", f"'{role}:' || text")) for p in states]
    drop = lambda p: _grow(f"w.{p}", "4", "D")
    return f"""SELECT w.conv_id, r.i, {drop("n")} AS n,
      least({", ".join([drop("s"), *keep("n", "s")])}) AS s,
      least({", ".join([drop("u"), *keep("nsa", "u"), *rerole("nsa", "user")])}) AS u,
      least({", ".join([drop("a"), *keep("u", "a"), *rerole("u", "assistant")])}) AS a
    FROM walk w JOIN rows_ r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1"""


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIRED = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) g(n))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
  FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, codes), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % 20 AS h FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(2) c(k) WHERE h <> 0 AND (k = 0 OR h = 3)),
marked AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {SPACES}) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged),
rows_ AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM marked),
walk AS (
  {_inserted("SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM conversations")}
  UNION ALL
  {_inserted(_row())}),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    least(w.n, w.a) AS best
  FROM walk w LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.i = coalesce(c.n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(left(best, 9) AS BIGINT) AS cost,
  substr(split_part(best, chr(1), 1), 10) AS audit, sha256(substr(best, strpos(best, chr(1)) + 1)) AS repaired_sha256
FROM ends
"""
