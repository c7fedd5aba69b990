"""SQL with the results of the vector compression and of the conversation repair, by other ways than theirs."""

from __future__ import annotations

_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
)


def compression(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every round compares all parts with all entries and sums all of them anew."""
    ctes = [
        f"""
k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM k QUALIFY entry < {entries}),
w AS MATERIALIZED (SELECT len(v) AS dims, len(v) // {parts} AS width FROM f WHERE entry = 0),
p AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, v FROM k, w WHERE len(v) = dims AND dims >= {parts}),
x AS MATERIALIZED (SELECT row, part, v[part * width + 1 : part * width + width] AS s FROM p, w, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, entry, v[part * width + 1 : part * width + width] AS s FROM f, w, range({parts}) t(part) WHERE len(v) = dims)"""
    ]
    far = "list_sum(list_transform(list_zip(x.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT row, x.part, min(struct_pack(d := {far}::BIGINT, e := entry)) AS near FROM x JOIN b{r} b ON b.part = x.part GROUP BY row, x.part)")
        if r < rounds:
            ctes.append(
                f"""
m{r} AS MATERIALIZED (SELECT part, entry, list(q ORDER BY i) AS s FROM (
  SELECT part, entry, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS q
  FROM (SELECT x.part, near.e AS entry, unnest(x.s) AS c, generate_subscripts(x.s, 1) AS i FROM a{r} a JOIN x ON x.row = a.row AND x.part = a.part) GROUP BY part, entry, i) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.s, b.s) AS s FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)"""
            )
    return f"""
WITH {", ".join(ctes)},
c AS (SELECT row, string_agg(printf('%02x', near.e), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN p USING (row)
"""


def _add(way: str, cost: str, edit: str) -> str:
    """A way (nine digits of cost, then its edits) with one edit more; none stays none."""
    return f"(lpad((left({way}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{edit}')"


def repair() -> str:
    """A fold over the rows of each conversation, which keeps the least way to each role written last."""
    keep, rerole = "CASE WHEN t THEN 1 ELSE 0 END", "CASE WHEN t THEN 3 ELSE 2 END"

    def one(s: str, letter: str) -> str:
        return f"CASE WHEN NOT r.d AND r.i = '{letter}' THEN {_add(s, keep.replace('t ', 'r.t '), 'K')} WHEN NOT r.d AND '{letter}' != 's' THEN {_add(s, rerole.replace('t ', 'r.t '), 'R')} END"

    w = [f"r.w[{i}]" for i in range(1, 5)]
    row = [
        _add(w[0], "3", "D"),
        f"least({_add(w[1], '3', 'D')}, {one(w[0], 's')})",
        f"least({_add(w[2], '3', 'D')}, {one(w[0], 'u')}, {one(w[1], 'u')}, {one(w[3], 'u')})",
        f"least({_add(w[3], '3', 'D')}, {one(w[2], 'a')})",
    ]
    user = f"least(n[3], {_add('n[1]', '2', 'I')}, {_add('n[2]', '2', 'I')}, {_add('n[4]', '2', 'I')})"
    inserted = f"SELECT {{0}}, [n[1], n[2], u, least(n[4], {_add('u', '2', 'I')})] AS w FROM (SELECT *, {user} AS u FROM ({{1}}))"
    first = inserted.format("conv_id, 0 AS k", "SELECT conv_id, ['000000000', NULL, NULL, NULL] AS n FROM c")
    then = inserted.format("conv_id, k", f"SELECT r.conv_id, r.k, [{', '.join(row)}] AS n FROM (SELECT f.conv_id, f.k, f.i, f.d, f.t, s.w FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k + 1) r")
    return rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("key")} % 20 AS harm
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
g AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE harm != 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM g),
q AS (SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS b, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
f AS MATERIALIZED (SELECT *, b OR again AS d, NOT b AND NOT again AND open AS t FROM q),
c AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END::BIGINT AS gaps, count_if(b)::BIGINT AS blank,
  count_if(NOT b AND again)::BIGINT AS duplicate, count_if(t)::BIGINT AS truncated, count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(k) AS n FROM f GROUP BY conv_id),
s AS ({first} UNION ALL {then}),
z AS (SELECT c.*, left(least(w[1], w[4]), 9)::BIGINT AS cost, substr(least(w[1], w[4]), 10) AS audit FROM s JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = c.n),
e AS (SELECT conv_id, audit[pos] AS edit, strlen(replace(audit[:pos], 'I', '')) AS k, strlen(replace(audit[:pos], 'D', '')) AS line FROM (SELECT *, unnest(range(1, strlen(audit) + 1)) AS pos FROM z)),
m AS (SELECT e.conv_id, e.line, e.edit, f.role, f.text, bool_or(e.line = 1 AND e.edit = 'K' AND f.i = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k AND e.edit != 'I' WHERE e.edit != 'D'),
t AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (line + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY line) AS lines FROM m GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
