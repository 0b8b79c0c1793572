"""DuckDB SQL of the conversation repair: the same costs by a recursion from each conversation's last row."""

from __future__ import annotations


def sql() -> str:
    # what each state can reach: cost, letters, lines; the least of them is the cheapest, ties by letters
    def row(state: int) -> str:
        turn = {0: ("user", 3), 1: ("user", 3), 2: ("assistant", 4), 3: ("user", 3)}[state]  # role, list place of the state after it
        keep = {0: "CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 END", 1: "CASE initial WHEN 'u' THEN 3 END",
                2: "CASE initial WHEN 'a' THEN 4 END", 3: "CASE initial WHEN 'u' THEN 3 END"}[state]
        dead, more = "fault IN ('blank', 'duplicate')", "CASE fault WHEN 'truncated' THEN 1 ELSE 0 END"
        ways = [f"{{'c': 3 + v[{state + 1}].c, 'e': 'D' || v[{state + 1}].e, 't': v[{state + 1}].t}}",
                f"CASE WHEN {dead} OR ({keep}) IS NULL THEN {{'c': 1000000, 'e': '', 't': []::VARCHAR[]}} ELSE "
                f"{{'c': {more} + v[{keep}].c, 'e': 'K' || v[{keep}].e, 't': list_concat([role || ':' || text], v[{keep}].t)}} END",
                f"CASE WHEN {dead} THEN {{'c': 1000000, 'e': '', 't': []::VARCHAR[]}} ELSE "
                f"{{'c': 2 + {more} + v[{turn[1]}].c, 'e': 'R' || v[{turn[1]}].e, 't': list_concat(['{turn[0]}:' || text], v[{turn[1]}].t)}} END"]
        return f"list_sort([{', '.join(ways)}])[1]"

    def insert(state: int) -> str:
        first, second = {0: ("user", "assistant"), 1: ("user", "assistant"), 2: ("assistant", "user"), 3: ("user", "assistant")}[state]
        place = {"user": 3, "assistant": 4}
        return (f"list_sort([b[{state + 1}], {{'c': 2 + b[{place[first]}].c, 'e': 'I' || b[{place[first]}].e, 't': list_concat(['{first}:'], b[{place[first]}].t)}}, "
                f"{{'c': 4 + b[{place[second]}].c, 'e': 'II' || b[{place[second]}].e, 't': list_concat(['{first}:', '{second}:'], b[{place[second]}].t)}}])[1]")

    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], key),
    lambda c, x: list_reduce(list_concat([xor(c, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE kind <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
z AS (SELECT g, max(i) + 1 AS i, [{{'c': 0, 'e': '', 't': []::VARCHAR[]}}, {{'c': 4, 'e': 'II', 't': ['user:', 'assistant:']}}, {{'c': 2, 'e': 'I', 't': ['assistant:']}},
    {{'c': 0, 'e': '', 't': []::VARCHAR[]}}] AS v FROM f GROUP BY g),
s AS (SELECT g, i, v FROM z UNION ALL SELECT g, i, [{', '.join(map(insert, range(4)))}]
  FROM (SELECT s.g, f.i, [{', '.join(map(row, range(4)))}] AS b FROM s JOIN f ON f.g = s.g AND f.i = s.i - 1)),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, any_value(g) AS g FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(s.v[1].c, 0)::BIGINT AS cost, coalesce(s.v[1].e, '') AS audit, sha256(coalesce(array_to_string(s.v[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.g = a.g AND s.i = 1"""
