"""SQL for the queries over clips. Tile columns are the first third of the picture and the rest."""

from __future__ import annotations

from .oracles import _CAND, _SAMPLE, _dequantized, _forward, _inverse, _level, _planar, _predictions, _scan

SIZES = (4, 8, 16, 32)
_LUMA = f"SELECT f, q // 96 AS py, q % 96 AS px_, px FROM ({_planar(144)}) WHERE q < 6144"


def _z(x: str, y: str) -> str:
    return " + ".join(f"(({x}) >> {i} & 1) * {4**i} + (({y}) >> {i} & 1) * {2 * 4**i}" for i in range(3))


def _placed(n: int, source: str) -> str:
    """source (blk) with gx, gy, f, tile and k, the place in coding order."""
    per = 32 // n
    cols = f"SELECT *, blk % 100 AS gx, blk // 100 % 100 AS gy, blk // 10000 AS f, CASE WHEN blk % 100 < {per} THEN 0 ELSE 1 END AS tile FROM ({source})"
    return f"SELECT *, ((gy // {per}) * CASE tile WHEN 0 THEN 1 ELSE 2 END + gx // {per} - tile) * 64 + ({_z(f'gx % {per}', f'gy % {per}')}) * {(n // 4) ** 2} AS k FROM ({cols})"


def _grid(n: int) -> str:
    cells = f"SELECT f * 10000 + py // {n} * 100 + px_ // {n} AS blk, list(px ORDER BY py, px_) AS a FROM ({_LUMA}) GROUP BY 1"
    return f"g AS (SELECT *, NULL::INT AS mode FROM ({_placed(n, cells)}))"


def _pr(n: int) -> str:
    return _predictions(n, _SAMPLE, grid=_grid(n), near=" AND {0}.f = g.f AND {0}.tile = g.tile AND {0}.k < g.k")


def _modes(n: int, rounds: int = 3) -> str:
    """CTEs pr<n> and then those of rounds, ending in d<n>: blk, mode, cost."""
    pick = "SELECT *, row_number() OVER (PARTITION BY blk ORDER BY cost, mode) AS r FROM ({0}) QUALIFY r = 1"
    out = [
        f"pr{n} AS MATERIALIZED (WITH {_pr(n)} SELECT * FROM pr)",
        f"s{n} AS MATERIALIZED (SELECT blk, mode, any_value(mask) AS mask, sum(abs(v - own))::BIGINT AS sad FROM pr{n} GROUP BY blk, mode)",
        f"m{n}_0 AS MATERIALIZED ({pick.format(f'SELECT blk, mode, sad + 96 AS cost FROM s{n}')})",
    ]
    for r in range(1, rounds + 1):
        near = f"""SELECT s.*, CASE WHEN mask & 2 > 0 THEN coalesce(l.mode, 1) ELSE 1 END AS a, CASE WHEN mask & 8 > 0 AND s.blk // 100 % 100 * {n} % 32 != 0 THEN coalesce(t.mode, 1) ELSE 1 END AS b
          FROM s{n} s LEFT JOIN m{n}_{r - 1} l ON l.blk = s.blk - 1 LEFT JOIN m{n}_{r - 1} t ON t.blk = s.blk - 100"""
        cost = f"SELECT blk, mode, sad + 32 * CASE WHEN mode = ({_CAND})[1] THEN 1 WHEN list_contains({_CAND}, mode) THEN 2 ELSE 3 END AS cost FROM ({near})"
        out.append(f"m{n}_{r} AS MATERIALIZED ({pick.format(cost)})")
    per = 32 // n
    node = f"((f * 2 + gy // {per}) * 3 + gx // {per}) * {per * per} + {_z(f'gx % {per}', f'gy % {per}')}"
    out.append(f"d{n} AS (SELECT {n} AS n, {SIZES.index(n)} AS level, blk, mode, cost, k, ({node})::BIGINT AS node FROM ({_placed(n, f'SELECT * FROM m{n}_{rounds}')}))")
    return ", ".join(out)


def _trees() -> str:
    """CTEs ending in leaf: the rows of d<n> that are leaves."""
    step = "q{0} AS (SELECT o.level, o.node, CASE WHEN c.n = 4 THEN least(cost, parts) ELSE cost END AS best, coalesce(c.n = 4 AND parts < cost, false) AS split FROM own o LEFT JOIN (SELECT node // 4 AS node, sum(best)::BIGINT AS parts, count(*) AS n FROM q{1} GROUP BY 1) c ON c.node = o.node WHERE o.level = {0})"
    union = " UNION ALL ".join(f"SELECT n, level, blk, mode, cost, k, node FROM d{n}" for n in SIZES)
    above = " ".join(f"AND (o.level + {i} > 3 OR EXISTS (SELECT 1 FROM q u WHERE u.split AND u.level = o.level + {i} AND u.node = o.node // {4**i}))" for i in (1, 2, 3))
    return f"""{", ".join(map(_modes, SIZES))}, own AS MATERIALIZED ({union}),
    q0 AS (SELECT level, node, cost AS best, false AS split FROM own WHERE level = 0), {", ".join(step.format(i, i - 1) for i in (1, 2, 3))},
    q AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(4))}),
    leaf AS MATERIALIZED (SELECT o.* FROM own o JOIN q ON q.level = o.level AND q.node = o.node WHERE NOT q.split {above})"""


def _coded() -> str:
    """CTEs ending in rec: n, blk, p, v (prediction), l (level), rec."""
    out = []
    for n in SIZES:
        own = f"SELECT pr.blk, pr.mode, p // {n} AS y, p % {n} AS x, v, own - v AS r FROM pr{n} pr JOIN leaf ON leaf.n = {n} AND leaf.blk = pr.blk AND leaf.mode = pr.mode"
        out.append(f"""rec{n} AS MATERIALIZED (WITH o AS MATERIALIZED ({own}), {_forward(n, n == 4, 'SELECT blk, y, x, r FROM o')}, lv AS (SELECT blk, y, x, {_level(32, n)} AS l FROM f), dq AS (SELECT blk, y, x, {_dequantized(32, n)} AS c FROM lv), {_inverse('dq')}
          SELECT {n} AS n, o.blk, o.mode, o.y * {n} + o.x AS p, o.v, lv.l, CASE WHEN bool_or(lv.l != 0) OVER (PARTITION BY o.blk) THEN least(255, greatest(0, o.v + i.v)) ELSE o.v END AS rec
          FROM o JOIN lv ON lv.blk = o.blk AND lv.y = o.y AND lv.x = o.x JOIN i ON i.blk = o.blk AND i.y = o.y AND i.x = o.x)""")
    return f"{_trees()}, {', '.join(out)}, rec AS ({' UNION ALL '.join(f'SELECT * FROM rec{n}' for n in SIZES)})"


#: Fixed values, as in the coefficients: first context of an element, what colour adds, initial values.
_FIRST = {"group": (40, 2, "91, 171, 134, 141"), "last_x": (86, 15, "110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63"), "last_y": (116, 15, "110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63"),
          "significant": (44, 27, "111, 111, 125, 110, 110, 94, 124, 108, 124, 107, 125, 141, 179, 153, 125, 107, 125, 141, 179, 153, 125, 107, 125, 141, 179, 153, 125, 140, 139, 182, 182, 152, 136, 152, 136, 153, 136, 139, 111, 136, 139, 111"),
          "over_one": (146, 16, "140, 92, 137, 138, 140, 152, 138, 139, 153, 74, 149, 92, 139, 107, 122, 152, 140, 179, 166, 182, 140, 227, 122, 197"), "over_two": (170, 4, "138, 153, 136, 167, 152, 152")}


def _bins(source: str = "") -> str:
    """CTEs ending in bins: n, blk, luma, grp, ord, element, bins, ctx (list). source: other levels (n, blk, luma, mode, y, x, l)."""
    key = "n, blk, luma"
    levels = " UNION ALL ".join(f"SELECT {n} AS n, blk, y, x, {_level(22, n)} AS l FROM (WITH {_forward(n)} SELECT * FROM f)" for n in SIZES)
    colour = lambda e: f"CASE WHEN luma THEN 0 ELSE {_FIRST[e][1]} END"
    log = "(length(bin(n)) - 1)"
    group = "CASE WHEN v < 4 THEN v ELSE 2 * (length(bin(v)) - 1) + (v >> (length(bin(v)) - 2) & 1) END"
    at = f"CASE WHEN luma THEN ({log} - 2) * 3 + (({log} - 1) >> 2) ELSE 15 END + (i >> CASE WHEN luma THEN ({log} + 1) >> 2 ELSE {log} - 2 END)"
    lasts = []
    for i, (axis, other) in enumerate((("x", "y"), ("y", "x"))):
        v = f"SELECT {key}, CASE WHEN kind = 'ver' THEN {other} ELSE {axis} END AS v FROM r WHERE pos = last"
        prefix = f"SELECT *, repeat('1', gi::INT) || CASE WHEN gi < 2 * {log} - 1 THEN '0' ELSE '' END AS b FROM (SELECT *, {group} AS gi FROM ({v}))"
        lasts.append(f"SELECT {key}, 1024 AS grp, {i} AS ord, 'last_{axis}' AS element, b AS bins, list_transform(range(0, length(b)), lambda i: {at}) AS ctx FROM ({prefix})")
        lasts.append(f"SELECT {key}, 1024, {i + 2}, 'last_{axis}_rest', lpad(bin(v - ((2 + gi % 2) << ((gi - 2) >> 1))), ((gi - 2) >> 1)::INT, '0'), NULL FROM (SELECT *, {group} AS gi FROM ({v})) WHERE gi > 3")
    near = "CASE WHEN {0} = 0 THEN 2 WHEN {0} = 1 THEN 1 ELSE 0 END"
    sig = f"""CASE WHEN x + y = 0 THEN 0 WHEN n = 4 THEN [0, 1, 4, 5, 2, 3, 4, 5, 6, 6, 8, 8, 7, 7, 8, 8][y * 4 + x + 1] ELSE
      CASE WHEN n = 8 THEN CASE kind WHEN 'diag' THEN 9 ELSE 15 END WHEN luma THEN 21 ELSE 12 END + CASE WHEN luma AND x // 4 + y // 4 > 0 THEN 3 ELSE 0 END
      + CASE hr + 2 * hl WHEN 0 THEN CASE WHEN x % 4 + y % 4 = 0 THEN 2 WHEN x % 4 + y % 4 <= 2 THEN 1 ELSE 0 END WHEN 1 THEN {near.format('y % 4')} WHEN 2 THEN {near.format('x % 4')} ELSE 2 END END + {colour('significant')}"""
    rest = """CASE WHEN pre < 3 THEN repeat('1', pre::INT) || '0' || CASE WHEN k = 0 THEN '' ELSE lpad(bin(v % (1::BIGINT << k)), k, '0') END
      ELSE repeat('1', length(bin(e)) - 1 - k + 3) || '0' || CASE WHEN length(bin(e)) = 1 THEN '' ELSE substr(bin(e), 2) END END"""
    prior = f"OVER (PARTITION BY {key}, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    scans = " UNION ALL ".join(_scan(n, k) for n in SIZES for k in ("diag", "hor", "ver"))
    source = source or f"SELECT *, blk * 7 % 35 AS mode FROM ({levels}), (SELECT unnest([true, false]) AS luma) WHERE luma OR n < 32"
    return f"""sc AS MATERIALIZED ({scans}), ch AS MATERIALIZED ({source}),
    ki AS (SELECT *, CASE WHEN n = 4 OR n = 8 AND luma THEN CASE WHEN mode BETWEEN 22 AND 30 THEN 'hor' WHEN mode BETWEEN 6 AND 14 THEN 'ver' ELSE 'diag' END ELSE 'diag' END AS kind FROM ch),
    o AS MATERIALIZED (SELECT {key}, kind, pos, pos // 16 AS g, y, x, l FROM ki JOIN sc USING (n, kind, y, x)),
    la AS (SELECT {key}, max(pos) AS last FROM o WHERE l != 0 GROUP BY ALL),
    r AS MATERIALIZED (SELECT o.*, last, last // 16 AS lg FROM o JOIN la USING ({key}) WHERE pos <= last),
    gf AS MATERIALIZED (SELECT DISTINCT {key}, y // 4 AS gy, x // 4 AS gx, 1 AS one FROM o WHERE l != 0),
    gr AS (SELECT DISTINCT {key}, g, lg, y // 4 AS gy, x // 4 AS gx FROM r),
    gp AS MATERIALIZED (SELECT gr.*, coalesce(a.one, 0) AS own, coalesce(b.one, 0) AS hr, coalesce(c.one, 0) AS hl FROM gr LEFT JOIN gf a USING ({key}, gy, gx)
      LEFT JOIN gf b ON b.n = gr.n AND b.blk = gr.blk AND b.luma = gr.luma AND b.gy = gr.gy AND b.gx = gr.gx + 1 LEFT JOIN gf c ON c.n = gr.n AND c.blk = gr.blk AND c.luma = gr.luma AND c.gy = gr.gy + 1 AND c.gx = gr.gx),
    nz AS MATERIALIZED (SELECT {key}, g, pos, abs(l) AS a, l < 0 AS neg, row_number() OVER (PARTITION BY {key}, g ORDER BY pos DESC) - 1 AS i FROM r WHERE l != 0),
    ga AS MATERIALIZED (SELECT *, CASE WHEN lag(any1) OVER (PARTITION BY {key} ORDER BY g DESC) THEN 1 ELSE 0 END + CASE WHEN g > 0 AND luma THEN 2 ELSE 0 END AS st
      FROM (SELECT {key}, g, bool_or(a > 1 AND i < 8) AS any1, count(*) AS c FROM nz GROUP BY ALL)),
    sg AS (SELECT r.*, hr, hl, max(CASE WHEN r.l != 0 THEN pos END) OVER (PARTITION BY {key}, r.g) AS top FROM r JOIN gp USING ({key}, g) WHERE own = 1 OR r.g IN (0, r.lg)),
    on1 AS (SELECT nz.*, st, count(CASE WHEN a > 1 THEN 1 END) {prior} AS more FROM nz JOIN ga USING ({key}, g) WHERE i < 8),
    re AS (SELECT *, CASE WHEN i < 8 THEN CASE WHEN count(CASE WHEN a >= 2 THEN 1 END) {prior} > 0 THEN 2 ELSE 3 END ELSE 1 END AS base FROM nz JOIN ga USING ({key}, g) WHERE any1 OR c > 8),
    rk AS (SELECT *, a - base AS v, list_reduce(list_prepend(0::BIGINT, coalesce(list(a) {prior}, [])), lambda k, b: CASE WHEN b > 3 * (1::BIGINT << k) AND k < 4 THEN k + 1 ELSE k END)::INT AS k FROM re WHERE a >= base),
    rc AS (SELECT *, v // (1::BIGINT << k) AS pre, v - 2 * (1::BIGINT << k) AS e FROM rk),
    bins AS ({" UNION ALL ".join(lasts)}
      UNION ALL SELECT {key}, g, 0, 'group', own::VARCHAR, [greatest(hr, hl) + {colour('group')}] FROM gp WHERE g NOT IN (0, lg)
      UNION ALL SELECT {key}, g, 1, 'significant', string_agg(CASE WHEN l != 0 THEN '1' ELSE '0' END, '' ORDER BY pos DESC), list({sig} ORDER BY pos DESC) FROM sg WHERE pos != last AND NOT (pos = g * 16 AND g != 0 AND (top IS NULL OR top = pos)) GROUP BY {key}, g
      UNION ALL SELECT {key}, g, 2, 'over_one', string_agg(CASE WHEN a > 1 THEN '1' ELSE '0' END, '' ORDER BY i), list(st * 4 + CASE WHEN more > 0 THEN 0 ELSE least(i + 1, 3) END + {colour('over_one')} ORDER BY i) FROM on1 GROUP BY {key}, g
      UNION ALL SELECT {key}, g, 3, 'over_two', CASE WHEN arg_min(a, i) > 2 THEN '1' ELSE '0' END, [any_value(st) + {colour('over_two')}] FROM on1 WHERE a > 1 GROUP BY {key}, g
      UNION ALL SELECT {key}, g, 4, 'sign', string_agg(CASE WHEN neg THEN '1' ELSE '0' END, '' ORDER BY i), NULL FROM nz GROUP BY {key}, g
      UNION ALL SELECT {key}, g, 5, 'rest', string_agg({rest}, '' ORDER BY i), NULL FROM rc GROUP BY {key}, g)"""


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    split = lambda n, k, name: f"SELECT p_partkey AS stream, j::INT AS tile_{name}, j * ({n}) // ({k}) AS start, (j + 1) * ({n}) // ({k}) AS stop FROM part, (SELECT unnest(range(0, 8)) AS j) WHERE j < {k}"
    out["tiles_of_blocks"] = f"""WITH e AS (SELECT event_id, p_partkey AS stream, event_id * 13 % (p_size + 3) AS x, event_id * 5 % (p_size % 9 + 2) AS y FROM events JOIN part ON p_partkey = event_id * 7 % (SELECT max(p_partkey) FROM part) + 1),
      c AS ({split('p_size + 3', 'p_size % 4 + 1', 'x')}), r AS ({split('p_size % 9 + 2', 'p_size % 2 + 1', 'y')})
      SELECT event_id, e.stream, tile_x, tile_y, x - c.start AS x_in_tile, y - r.start AS y_in_tile FROM e JOIN c ON c.stream = e.stream AND x >= c.start AND x < c.stop JOIN r ON r.stream = e.stream AND y >= r.start AND y < r.stop"""
    order = lambda n: f"SELECT {n} AS n, f::INT AS frame_no, gx::INT AS bx, gy::INT AS by, tile::INT AS tile, k::BIGINT AS place FROM ({_placed(n, f'SELECT DISTINCT f * 10000 + py // {n} * 100 + px_ // {n} AS blk FROM ({_LUMA})')})"
    out["tile_order"] = " UNION ALL ".join(map(order, SIZES))
    out["tile_borders"] = " UNION ALL ".join(f"SELECT {n} AS n, blk, tile, mask, list_sum(r0)::BIGINT AS total, md5(array_to_string(r0, ',')) AS digest FROM (WITH {_pr(n)} SELECT b6.*, g.tile FROM b6 JOIN g ON g.blk = b6.blk)" for n in SIZES)
    out["tile_modes"] = f"WITH {', '.join(map(_modes, SIZES))} " + " UNION ALL ".join(f"SELECT n, blk, mode, cost FROM d{n}" for n in SIZES)
    out["tree_leaves"] = f"WITH {_trees()} SELECT n, blk, k AS place, mode, cost FROM leaf"
    out["colour_blocks"] = f"""WITH {_trees()}, a AS (SELECT CASE WHEN level = 0 THEN 1 ELSE level END AS level, CASE WHEN level = 0 THEN node // 4 ELSE node END AS area, node, mode FROM leaf)
      SELECT (2 << level)::INT AS n, area AS node, count(*) AS luma_leaves, arg_min(mode, node) AS luma_mode FROM a GROUP BY level, area"""
    text = lambda c: f"md5(string_agg({c}::VARCHAR, ',' ORDER BY p))"
    out["leaf_reconstruction"] = f"WITH {_coded()} SELECT n, blk, mode, {text('v')} AS prediction, {text('l')} AS level, sum(abs(l))::BIGINT AS levels, {text('rec')} AS rec FROM rec GROUP BY n, blk, mode"
    out["decoded_psnr"] = f"""WITH {_coded()}, x AS (SELECT blk // 10000 AS f, blk // 100 % 100 * n + p // n AS py, blk % 100 * n + p % n AS px_, rec FROM rec)
      SELECT f::INT AS frame_no, CASE WHEN sse > 0 THEN round(10 * log10(65025.0::DOUBLE * 6144 / sse), 6) END AS psnr_y FROM (SELECT x.f, sum((px - rec) * (px - rec))::BIGINT AS sse FROM x JOIN ({_LUMA}) l ON l.f = x.f AND l.py = x.py AND l.px_ = x.px_ GROUP BY x.f)"""
    out["coefficient_bins"] = f"WITH {_bins()} SELECT n, blk, luma, grp::INT AS grp, ord, element, bins, array_to_string(ctx, ',') AS ctx FROM bins"
    tables = " UNION ALL ".join(f"SELECT '{e}' AS element, {first} AS first, [{v}] AS vals" for e, (first, _, v) in _FIRST.items())
    out["bin_contexts"] = f"""WITH {_bins()}, t AS ({tables}), e AS (SELECT n, blk, luma, grp, ord, element, first, vals, unnest(ctx) AS c, unnest(string_split(bins, '')) AS bin, unnest(range(0, length(bins))) AS i FROM bins JOIN t USING (element)),
      s AS (SELECT *, least(126, greatest(1, (((vals[c + 1] >> 4) * 5 - 45) * 22 >> 4) + (vals[c + 1] & 15) * 8 - 16)) AS q FROM e)
      SELECT n, blk, luma, grp::INT AS grp, ord, element, i::INT AS i, bin::INT AS bin, (first + c)::INT AS context, CASE WHEN q > 63 THEN (q - 64) * 2 + 1 ELSE (63 - q) * 2 END AS state FROM s"""
    hexed = "array_to_string(list_transform(range(0, length(b) // 8), lambda i: printf('%02X', list_sum(list_transform(range(0, 8), lambda j: substr(b, i * 8 + j + 1, 1)::INT * (1 << (7 - j))))::INT)), '')"
    out["packed_bins"] = f"""WITH {_bins()}, w AS (SELECT n, luma, string_agg(bins, '' ORDER BY blk, grp DESC, ord) AS b FROM bins GROUP BY n, luma),
      c AS (SELECT n, luma, unnest(range(0, (length(b) + 2047) // 2048)) AS chunk, b FROM w), p AS (SELECT n, luma, chunk, substr(b, chunk * 2048 + 1, 2048) AS b FROM c),
      z AS (SELECT n, luma, chunk, rpad(b, ((length(b) + 7) // 8 * 8)::INT, '0') AS b FROM p)
      SELECT n, luma, chunk, (length(b) // 8)::INT AS n_bytes, md5(unhex({hexed})) AS digest FROM z"""
    leveled = "SELECT r.n, r.blk, true AS luma, r.mode, r.p // r.n AS y, r.p % r.n AS x, r.l FROM rec r"
    less = lambda size: f"(CASE WHEN coalesce(left_size, 99) < {size} THEN 1 ELSE 0 END + CASE WHEN coalesce(top_size, 99) < {size} THEN 1 ELSE 0 END)::VARCHAR"
    idx = "CASE WHEN list_contains(cd, mode) THEN list_position(cd, mode) - 1 ELSE mode - len(list_filter(cd, lambda q: q < mode)) + 3 END"
    out["tree_syntax"] = f"""WITH {_coded()}, {_bins(leveled)},
      lf AS MATERIALIZED (SELECT n, blk, mode, k, f, tile, blk % 100 * n // 4 AS cx, blk // 100 % 100 * n // 4 AS cy FROM (SELECT *, blk // 10000 AS f, CASE WHEN blk % 100 < 32 // n THEN 0 ELSE 1 END AS tile FROM leaf)),
      cl AS MATERIALIZED (SELECT f, tile, n, mode, cx + i % (n // 4) AS x, cy + i // (n // 4) AS y FROM (SELECT *, unnest(range(0, (n // 4) * (n // 4))) AS i FROM lf)),
      ar AS MATERIALIZED (SELECT lf.*, a.n AS left_size, b.n AS top_size, coalesce(a.mode, 1) AS a, CASE WHEN cy % 8 = 0 THEN 1 ELSE coalesce(b.mode, 1) END AS b FROM lf
        LEFT JOIN cl a ON a.f = lf.f AND a.tile = lf.tile AND a.x = cx - 1 AND a.y = cy LEFT JOIN cl b ON b.f = lf.f AND b.tile = lf.tile AND b.x = cx AND b.y = cy - 1),
      ix AS (SELECT *, {idx} AS idx, CASE WHEN n = 4 THEN k - k % 4 ELSE k END AS first FROM (SELECT *, {_CAND} AS cd FROM ar))
      SELECT f::INT AS frame_no, tile::INT AS tile, place::BIGINT AS place, step, down::INT AS down, part::INT AS part, element, bins, ctx FROM (
        SELECT f, tile, k AS place, 0 AS step, 0 AS down, 0 AS part, 'split' AS element, CASE WHEN n < 32 THEN '1' ELSE '0' END AS bins, {less(32)} AS ctx FROM ix WHERE k % 64 = 0
        UNION ALL SELECT f, tile, k, 1, 0, 0, 'split', CASE WHEN n < 16 THEN '1' ELSE '0' END, {less(16)} FROM ix WHERE k % 16 = 0 AND n <= 16
        UNION ALL SELECT f, tile, k, 2, 0, 0, 'part', CASE WHEN n != 4 THEN '1' ELSE '0' END, '0' FROM ix WHERE k % 4 = 0 AND n <= 8
        UNION ALL SELECT f, tile, first, 3, 0, k % 4, 'luma_mode', CASE WHEN idx < 3 THEN '1' ELSE '0' END, '0' FROM ix
        UNION ALL SELECT f, tile, first, 4, 0, k % 4, 'luma_mode_rest', CASE idx WHEN 0 THEN '0' WHEN 1 THEN '10' WHEN 2 THEN '11' ELSE lpad(bin(idx - 3), 5, '0') END, NULL FROM ix
        UNION ALL SELECT f, tile, k, 5, 0, 0, 'coded', CASE WHEN c THEN '1' ELSE '0' END, CASE WHEN n = 4 THEN '0' ELSE '1' END FROM lf JOIN (SELECT n, blk, bool_or(l != 0) AS c FROM rec GROUP BY n, blk) USING (n, blk)
        UNION ALL SELECT f, tile, k, 6, 1024 - grp, ord, element, bins, array_to_string(ctx, ',') FROM bins JOIN lf USING (n, blk))"""
    plane = "CASE WHEN q < 6144 THEN 'y' WHEN q < 7680 THEN 'cb' ELSE 'cr' END"
    out["planes_round_trip"] = f"SELECT f::INT AS frame_no, {plane} AS plane, count(*)::INT AS n_bytes, md5(unhex(string_agg(printf('%02X', px), '' ORDER BY q))) AS digest FROM ({_planar(144)}) GROUP BY ALL"
    return out
