"""SQL for the queries of the catalogue, written over exploded rows, with fixed values of its own."""

from __future__ import annotations

#: Fixed values of the public H.265 specification, as lists in SQL: displacements of the modes 2 to 34, the
#: same divided into 8192, the first column of the 32-point cosine matrix, chroma QPs from luma QP 30 on (of an earlier draft: the final edition differs at 34 and from 44 on).
_ANGLES = "[32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32]"
_INVERSE = "[256, 315, 390, 482, 630, 910, 1638, 4096, 0, -4096, -1638, -910, -630, -482, -390, -315, -256, -315, -390, -482, -630, -910, -1638, -4096, 0, 4096, 1638, 910, 630, 482, 390, 315, 256]"
_COSINE = "[64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4]"
_SINE = "[[29, 55, 74, 84], [74, 74, 0, -74], [84, -29, -74, 55], [55, -84, 74, -29]]"
_QUANT = {22: 16384, 27: 18396, 32: 20560, 37: 23302}
_DEQUANT = {32: 51}
_CHROMA_QP = "[29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39]"

_PX = "SELECT vec_id, label, p - 1 AS p, least(255, greatest(0, floor(embedding[p]::DOUBLE * 256)::INT + 128)) AS px FROM embeddings, (SELECT unnest(range(1, 65)) AS p)"
_RES = "SELECT vec_id, p - 1 AS p, least(255, greatest(-255, floor(embedding[p]::DOUBLE * 256)::INT)) AS r FROM embeddings, (SELECT unnest(range(1, 65)) AS p)"
_TILES = "SELECT l_orderkey AS frame, o_custkey AS gop, year(o_orderdate) AS year, l_linenumber AS tile, sum(l_quantity)::BIGINT AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
_BLEN = "CASE WHEN ({0}) = 0 THEN 0 ELSE length(bin({0})) END"
_UE = "repeat('0', length(bin({0} + 1)) - 1) || bin({0} + 1)"


def _planar(many: int) -> str:
    """f, q, px: samples of frames of so many vectors in planar order; what the last one lacks is 128."""
    own = f"SELECT vec_id // {many} AS f, vec_id % {many} * 64 + p AS q, px FROM ({_PX})"
    return f"SELECT a.f, a.q, coalesce(b.px, 128) AS px FROM (SELECT f, unnest(range(0, {many * 64})) AS q FROM (SELECT DISTINCT vec_id // {many} AS f FROM embeddings)) a LEFT JOIN ({own}) b ON b.f = a.f AND b.q = a.q"


def _cells(n: int, source: str = _RES) -> str:
    """blk, y, x, r of blocks of n x n. source: vec_id, p, r."""
    if n == 8:
        return f"SELECT vec_id AS blk, (p // 8)::INT AS y, (p % 8)::INT AS x, r FROM ({source})"
    if n == 4:
        return f"SELECT vec_id * 4 + p // 32 * 2 + p % 8 // 4 AS blk, (p // 8 % 4)::INT AS y, (p % 4)::INT AS x, r FROM ({source})"
    many = (n // 8) ** 2
    q = f"(vec_id % {many})"
    # what the last block lacks is 0 in residuals and 128 in samples
    fill = 0 if source == _RES else 205 if source == _OTHER_SAMPLE else 128
    every = f"SELECT v AS vec_id, p, coalesce(r, {fill}) AS r FROM (SELECT blk * {many} + unnest(range(0, {many})) AS v FROM (SELECT DISTINCT vec_id // {many} AS blk FROM embeddings)) CROSS JOIN (SELECT unnest(range(0, 64)) AS p) LEFT JOIN (SELECT vec_id AS v, p, r FROM ({source})) USING (v, p)"
    return f"""SELECT vec_id // {many} AS blk, (p // 8 + 8 * (({q} >> 1 & 1) + 2 * ({q} >> 3 & 1)))::INT AS y, (p % 8 + 8 * (({q} & 1) + 2 * ({q} >> 2 & 1)))::INT AS x, r FROM ({every})"""


def _m(n: int, sine: bool) -> str:
    every = f"(SELECT unnest(range(0, {n})) AS k), (SELECT unnest(range(0, {n})) AS x)"
    if sine:
        return f"m(k, x, c) AS (SELECT k, x, {_SINE}[k + 1][x + 1] FROM {every})"
    return f"""m(k, x, c) AS (SELECT k, x, CASE WHEN k = 0 THEN 64 WHEN a = 32 THEN 0 WHEN a > 32 THEN -{_COSINE}[65 - a] ELSE {_COSINE}[a + 1] END
      FROM (SELECT k, x, least(b, 128 - b) AS a FROM (SELECT k, x, (2 * x + 1) * k * {32 // n} % 128 AS b FROM {every})))"""


def _forward(n: int, sine: bool = False, cells: str = "") -> str:
    """CTEs ending in f(blk, y, x, c). cells: other residuals (blk, y, x, r) than those of the vectors."""
    log = n.bit_length() - 1
    return f"""{_m(n, sine)}, r0 AS ({cells or _cells(n)}),
    f1 AS (SELECT blk, r0.y, m.k AS x, (sum(m.c * r) + {1 << log - 2 if log > 1 else 0})::BIGINT >> {log - 1} AS c FROM r0 JOIN m ON m.x = r0.x GROUP BY ALL),
    f AS (SELECT blk, m.k AS y, f1.x AS x, (sum(m.c * f1.c) + {1 << log + 5})::BIGINT >> {log + 6} AS c FROM f1 JOIN m ON m.x = f1.y GROUP BY ALL)"""


def _inverse(source: str) -> str:
    return f"""i1 AS (SELECT blk, m.x AS y, s.x AS x, least(32767, greatest(-32768, (sum(m.c * s.c) + 64)::BIGINT >> 7)) AS c FROM {source} s JOIN m ON m.k = s.y GROUP BY ALL),
    i AS (SELECT blk, i1.y AS y, m.x AS x, least(32767, greatest(-32768, (sum(m.c * i1.c) + 2048)::BIGINT >> 12)) AS v FROM i1 JOIN m ON m.k = i1.x GROUP BY ALL)"""


def _level(qp: int, n: int = 8) -> str:
    bits = 14 + qp // 6 + 8 - n.bit_length()
    return f"(sign(c) * ((abs(c) * {_QUANT[qp]} + {171 << bits - 9}) >> {bits}))::INT"


def _dequantized(qp: int, n: int = 8) -> str:
    shift = n.bit_length() - 2
    return f"least(32767, greatest(-32768, (l * {_DEQUANT[qp] << qp // 6} + {1 << shift - 1}) >> {shift}))"


_SAMPLE = _PX.replace(" AS px FROM", " AS r FROM")
_OTHER_SAMPLE = f"SELECT vec_id, p, (r * 5 + 77) % 256 AS r FROM ({_SAMPLE})"


def _predictions(n: int, source: str = _SAMPLE, chroma: bool = False, grid: str = "", near: str = "") -> str:
    """CTEs ending in pr: blk, mode, p, v (prediction), own (sample), ll and tl (modes left and above), mask (neighbours there).

    grid: other CTEs ending in g (blk, gx, gy, a, mode); near: further conditions on a neighbour {0}."""
    nn, c, log = n * n, 2 * n + 1, n.bit_length() - 1
    many = max(1, n // 8) ** 2
    at = "(blk // 4) % 10 * 2 + blk % 2 AS gx, blk // 40 * 2 + blk % 4 // 2 AS gy" if n == 4 else "blk % 10 AS gx, blk // 10 AS gy"
    first = "blk // 4" if n == 4 else f"blk * {many}"
    column = lambda t: f"list_transform(range(0, {n}), lambda i: {t}.a[{nn} - {n} * i])"
    row = lambda t: f"{t}.a[{nn - n + 1}:{nn}]"
    fill = lambda v, k=n: f"list_transform(range(0, {k}), lambda i: {v})"
    whole = {8: 7, 16: 1, 32: 0}.get(n, 99)
    smooth = "false" if chroma or n == 4 else f"mode = 0 OR mode > 1 AND least(abs(mode - 10), abs(mode - 26)) > {whole}"
    edges = "" if chroma else f"""WHEN rr.mode = 1 AND p = 0 THEN (r[{c - 1}] + 2 * dc + r[{c + 1}] + 2) >> 2 WHEN rr.mode = 1 AND x = 0 THEN (r[{c - 1} - y] + 3 * dc + 2) >> 2 WHEN rr.mode = 1 AND y = 0 THEN (r[{c + 1} + x] + 3 * dc + 2) >> 2
      WHEN rr.mode = 26 AND x = 0 THEN least(255, greatest(0, r[{c + 1}] + ((r[{c - 1} - y] - r[{c}]) >> 1)))
      WHEN rr.mode = 10 AND y = 0 THEN least(255, greatest(0, r[{c - 1}] + ((r[{c + 1} + x] - r[{c}]) >> 1)))"""
    grid = grid or f"""g0 AS (SELECT blk, list(r ORDER BY y, x) AS a FROM ({_cells(n, source)}) GROUP BY blk),
g AS (SELECT g0.blk, a, {at}, (e.label * 11 % 35)::INT AS mode FROM g0 JOIN embeddings e ON e.vec_id = {first.replace('blk', 'g0.blk')})"""
    side = lambda a, dx, dy: f"LEFT JOIN g {a} ON {a}.gx = g.gx + {dx} AND {a}.gy = g.gy + {dy}{near.format(a)}"
    mask = " + ".join(f"CASE WHEN {a}.blk IS NULL THEN 0 ELSE {1 << i} END" for i, a in enumerate(("lb", "l", "c", "t", "tr")))
    return f"""{grid},
b0 AS (SELECT g.blk, g.a, {mask} AS mask, l.mode AS ll, CASE WHEN g.gy * {n} % 32 != 0 THEN t.mode END AS tl,
  CASE WHEN lb.blk IS NOT NULL THEN {column('lb')} END AS q1, CASE WHEN l.blk IS NOT NULL THEN {column('l')} END AS q2, CASE WHEN c.blk IS NOT NULL THEN [c.a[{nn}]] END AS q3,
  CASE WHEN t.blk IS NOT NULL THEN {row('t')} END AS q4, CASE WHEN tr.blk IS NOT NULL THEN {row('tr')} END AS q5
  FROM g {side('lb', -1, 1)} {side('l', -1, 0)} {side('c', -1, -1)} {side('t', 0, -1)} {side('tr', 1, -1)}),
b1 AS (SELECT * REPLACE (coalesce(q1, {fill('coalesce(q2[1], q3[1], q4[1], q5[1], 128)')}) AS q1) FROM b0),
b2 AS (SELECT * REPLACE (coalesce(q2, {fill('q1[-1]')}) AS q2) FROM b1), b3 AS (SELECT * REPLACE (coalesce(q3, [q2[-1]]) AS q3) FROM b2),
b4 AS (SELECT * REPLACE (coalesce(q4, {fill('q3[-1]')}) AS q4) FROM b3), b5 AS (SELECT * REPLACE (coalesce(q5, {fill('q4[-1]')}) AS q5) FROM b4),
b6 AS (SELECT blk, a AS own, ll, tl, mask, q1 || q2 || q3 || q4 || q5 AS r0 FROM b5),
bs AS (SELECT *, list_transform(range(1, {4 * n + 2}), lambda i: CASE WHEN i IN (1, {4 * n + 1}) THEN r0[i] ELSE (r0[i-1] + 2 * r0[i] + r0[i+1] + 2) >> 2 END) AS r1 FROM b6),
md AS (SELECT mode, coalesce({_ANGLES}[mode - 1], 0) AS a, coalesce({_INVERSE}[mode - 1], 0) AS inv, CASE WHEN mode >= 18 THEN 1 ELSE -1 END AS d FROM (SELECT unnest(range(0, 35)) AS mode)),
xy AS (SELECT q // {n} AS y, q % {n} AS x, q AS p FROM (SELECT unnest(range(0, {nn})) AS q)),
kk AS (SELECT mode, a, inv, d, y, x, p, (CASE WHEN d > 0 THEN x ELSE y END) + (((CASE WHEN d > 0 THEN y ELSE x END) + 1) * a >> 5) + 1 AS k, (((CASE WHEN d > 0 THEN y ELSE x END) + 1) * a) & 31 AS f FROM md, xy),
pl AS (SELECT mode, y, x, p, f, CASE WHEN k >= 0 THEN {c} + d * k ELSE {c} - d * ((k * inv + 128) >> 8) END AS i1, CASE WHEN f = 0 THEN {c} WHEN k + 1 >= 0 THEN {c} + d * (k + 1) ELSE {c} - d * (((k + 1) * inv + 128) >> 8) END AS i2 FROM kk),
rr AS (SELECT blk, own, ll, tl, mask, mode, CASE WHEN {smooth} THEN r1 ELSE r0 END AS r FROM bs, md),
dc AS (SELECT blk, (list_sum(r0[{c - n}:{c - 1}]) + list_sum(r0[{c + 1}:{c + n}]) + {n})::INT >> {log + 1} AS dc FROM bs),
pr AS (SELECT rr.blk, rr.mode, p, own[p + 1] AS own, ll, tl, mask, CASE
  WHEN rr.mode = 0 THEN (({n - 1} - x) * r[{c - 1} - y] + (x + 1) * r[{c + n + 1}] + ({n - 1} - y) * r[{c + 1} + x] + (y + 1) * r[{c - n - 1}] + {n}) >> {log + 1}
  {edges}
  WHEN rr.mode = 1 THEN dc
  ELSE ((32 - f) * r[i1] + f * r[i2] + 16) >> 5 END AS v
  FROM rr JOIN pl ON pl.mode = rr.mode JOIN dc ON dc.blk = rr.blk)"""


def _digests(sizes: tuple[int, ...], where: str, chroma: bool = False) -> str:
    one = lambda n: f"SELECT {n} AS n, blk, mode, sum(v)::BIGINT AS total, md5(string_agg(v::VARCHAR, ',' ORDER BY p)) AS digest FROM (WITH {_predictions(n, chroma=chroma)} SELECT * FROM pr WHERE {where}) GROUP BY blk, mode"
    return " UNION ALL ".join(one(n) for n in sizes)


_CAND = "CASE WHEN a = b THEN CASE WHEN a < 2 THEN [0, 1, 26] ELSE [a, 2 + (a + 29) % 32, 2 + (a - 1) % 32] END ELSE [a, b, CASE WHEN a != 0 AND b != 0 THEN 0 WHEN a != 1 AND b != 1 THEN 1 ELSE 26 END] END"
_NEAR = "SELECT sad.*, coalesce(ll, 1) AS a, coalesce(tl, 1) AS b FROM sad"


def _luma(n: int) -> str:
    """n, blk, mode, cost."""
    return f"""SELECT {n} AS n, blk, mode, cost FROM (WITH {_predictions(n)}, sad AS (SELECT blk, mode, any_value(ll) AS ll, any_value(tl) AS tl, sum(abs(v - own))::BIGINT AS sad FROM pr GROUP BY blk, mode),
cost AS (SELECT blk, mode, sad + 32 * CASE WHEN mode = ({_CAND})[1] THEN 1 WHEN list_contains({_CAND}, mode) THEN 2 ELSE 3 END AS cost FROM ({_NEAR}))
SELECT *, row_number() OVER (PARTITION BY blk ORDER BY cost, mode) AS k FROM cost) WHERE k = 1"""


def _chroma(n: int) -> str:
    sad = lambda source: f"SELECT blk, mode, sum(abs(v - own))::BIGINT AS sad FROM (WITH {_predictions(n, source, chroma=True)} SELECT * FROM pr) GROUP BY blk, mode"
    return f"""SELECT {n} AS n, blk, mode, cost FROM (WITH luma AS ({_luma(n)}), s1 AS ({sad(_SAMPLE)}), s2 AS ({sad(_OTHER_SAMPLE)}),
    c5 AS (SELECT blk, unnest([CASE WHEN mode = 0 THEN 34 ELSE 0 END, CASE WHEN mode = 26 THEN 34 ELSE 26 END, CASE WHEN mode = 10 THEN 34 ELSE 10 END, CASE WHEN mode = 1 THEN 34 ELSE 1 END, mode]) AS mode, unnest([0, 1, 2, 3, 4]) AS i FROM luma)
    SELECT c5.blk, c5.mode, x.sad + y.sad AS cost, row_number() OVER (PARTITION BY c5.blk ORDER BY x.sad + y.sad, i) AS k FROM c5 JOIN s1 x ON x.blk = c5.blk AND x.mode = c5.mode JOIN s2 y ON y.blk = c5.blk AND y.mode = c5.mode) WHERE k = 1"""


_LABELS = f"""WITH e AS (SELECT vec_id, (label * 11 % 35)::INT AS mode FROM embeddings),
n AS (SELECT e.vec_id, e.mode, coalesce(l.mode, 1) AS a, coalesce(t.mode, 1) AS b FROM e LEFT JOIN e l ON l.vec_id = e.vec_id - 1 AND e.vec_id % 10 > 0 LEFT JOIN e t ON t.vec_id = e.vec_id - 10 AND e.vec_id // 10 % 4 > 0),
c AS (SELECT vec_id, mode, {_CAND} AS c FROM n)"""
_IDX = "CASE WHEN list_contains(c, mode) THEN list_position(c, mode) - 1 ELSE mode - len(list_filter(c, lambda q: q < mode)) + 3 END"


def _scan(n: int, kind: str) -> str:
    gy, gx, iy, ix = "y // 4", "x // 4", "y % 4", "x % 4"
    key = {"diag": f"{gx} + {gy}, {gx}, {ix} + {iy}, {ix}", "hor": f"{gy}, {gx}, {iy}, {ix}", "ver": f"{gx}, {gy}, {ix}, {iy}"}[kind]
    return f"SELECT {n} AS n, '{kind}' AS kind, row_number() OVER (ORDER BY {key}) - 1 AS pos, y, x FROM (SELECT i // {n} AS y, i % {n} AS x FROM (SELECT unnest(range(0, {n * n})) AS i))"


def all_sql(qps: tuple[int, ...]) -> dict[str, str]:
    out: dict[str, str] = {}
    pair = f"WITH a AS ({_PX}), d AS (SELECT a.vec_id, {{0}} FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND b.p = a.p GROUP BY a.vec_id)"
    sse = pair.format("sum((a.px - b.px) * (a.px - b.px))::BIGINT AS sse")
    psnr = "CASE WHEN sse > 0 THEN round(10 * log10(65025.0::DOUBLE * 64 / sse), 6) END"
    out["psnr_block_pairs"] = f"{sse} SELECT vec_id, sse, {psnr} AS psnr FROM d"
    mean = "round(avg(CASE WHEN {0} THEN psnr END), 4) AS {1}"
    out["psnr_weighted_avg"] = f"{sse}, q AS (SELECT vec_id, {psnr} AS psnr FROM d), a3 AS (SELECT {mean.format('vec_id % 6 < 4', 'y')}, {mean.format('vec_id % 6 = 4', 'cb')}, {mean.format('vec_id % 6 = 5', 'cr')} FROM q) SELECT *, round((4 * y + cb + cr) / 6, 4) AS mean FROM a3"
    plane = "CASE WHEN q < 1024 THEN 'y' WHEN q < 1280 THEN 'cb' ELSE 'cr' END"
    squares = f"SELECT f, {plane} AS plane, count(*) AS n, sum((px - c) * (px - c))::BIGINT AS sse FROM (SELECT f, q, px, least(255, px // 6 * 6 + 3) AS c FROM ({_planar(24)})) GROUP BY ALL"
    decibel = "max(CASE WHEN plane = '{0}' AND sse > 0 THEN 10 * log10(65025.0::DOUBLE * n / sse) END) AS psnr_{0}"
    planar = f"SELECT f::INT AS frame_no, round(psnr_y, 6) AS psnr_y, round(psnr_cb, 6) AS psnr_cb, round(psnr_cr, 6) AS psnr_cr, round((4 * psnr_y + psnr_cb + psnr_cr) / 6, 6) AS psnr FROM (SELECT f, {', '.join(map(decibel.format, ('y', 'cb', 'cr')))} FROM ({squares}) GROUP BY f)"
    out["planar_psnr"] = planar
    out["planar_blocks"] = f"""SELECT f::INT AS frame_no, (q % 32 // 8)::INT AS bx, (q // 256)::INT AS by, sum(px)::BIGINT AS total, md5(string_agg(px::VARCHAR, ',' ORDER BY q)) AS digest
      FROM ({_planar(24)}) WHERE q < 1024 GROUP BY ALL"""
    sized = f"SELECT *, frame_no * 37 % 1000 + 500 AS bytes FROM ({planar})"
    out["distortion_report"] = f"""SELECT frame_no::VARCHAR AS frame, round(bytes / 1024, 6) AS kib, psnr_y, psnr_cb, psnr_cr FROM ({sized})
      UNION ALL SELECT 'avg', round(avg(bytes) * 30 / 1024, 6), round(avg(psnr_y), 6), round(avg(psnr_cb), 6), round(avg(psnr_cr), 6) FROM ({sized})"""
    frames = f"SELECT frame, year, sum(bytes)::BIGINT AS bytes FROM ({_TILES}) GROUP BY ALL"
    out["rd_report"] = f"SELECT 'frame' AS kind, frame, round(bytes / 1024, 6) AS kib, NULL::DOUBLE AS kib_per_s FROM ({frames}) UNION ALL SELECT 'avg', NULL, NULL, round(avg(bytes) * 30 / 1024, 6) FROM ({frames})"
    out["bytes_rollup"] = f"SELECT (3 - bit_count(grouping(gop, frame, tile)::INT))::INT AS level, gop, frame, tile, sum(bytes)::BIGINT AS bytes FROM ({_TILES}) GROUP BY ROLLUP (gop, frame, tile)"
    out["byte_rate"] = f"SELECT year::INT AS year, count(*) AS frames, round(avg(bytes) * 30 / 1024, 6) AS kib_per_s FROM ({frames}) GROUP BY year"
    out["stats_wide"] = f"SELECT frame, {', '.join(f'sum(bytes) FILTER (tile = {i})::BIGINT AS tile{i}_bytes' for i in range(1, 8))} FROM ({_TILES}) GROUP BY frame"
    split = "SELECT p_partkey, k::INT AS k, j::INT AS j, j * p_size // k AS start, (j + 1) * p_size // k - j * p_size // k AS size FROM part, (SELECT unnest(range(1, 6)) AS k), (SELECT unnest(range(0, 5)) AS j) WHERE j < k"
    out["tile_split_uniform"] = split
    out["largest_tile"] = f"SELECT p_partkey, k, max(size) AS most FROM ({split}) GROUP BY p_partkey, k"
    out["tile_bounds"] = f"SELECT p_partkey, j, start * 32 AS first_pel, (start + size) * 32 - 1 AS last_pel FROM ({split}) WHERE k = 3"
    out["block_address"] = "SELECT event_id, n AS number, n % 60 * 32 AS x, n // 60 * 32 AS y, n AS back FROM (SELECT event_id, event_id % 2040 AS n FROM events)"
    out["blocks_in_tiles"] = "WITH t AS (SELECT p_partkey, p_size % 4 + 1 AS w, p_size % 3 + 1 AS h, p_size % 7 AS x0, p_size % 5 AS y0 FROM part), q AS (SELECT *, unnest(range(0, w * h)) AS seq FROM t) SELECT p_partkey, seq, x0 + seq % w AS bx, y0 + seq // w AS by, seq = w * h - 1 AS is_last FROM q"
    out["zorder_xy"] = "SELECT event_id, (z & 1) + 2 * (z >> 2 & 1) + 4 * (z >> 4 & 1) AS x, (z >> 1 & 1) + 2 * (z >> 3 & 1) + 4 * (z >> 5 & 1) AS y FROM (SELECT event_id, event_id % 64 AS z FROM events)"
    out["bit_length"] = f"SELECT o_orderkey, {_BLEN.format('o_orderkey')} AS bits FROM orders"
    out["block_explode"] = f"SELECT vec_id, p // 8 AS y, p % 8 AS x, px FROM ({_PX})"
    out["sad_pairs"] = pair.format("sum(abs(a.px - b.px))::BIGINT AS sad") + " SELECT vec_id, sad, sad // 64 AS mad FROM d"
    out["ref_fill"] = """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type != 'error' THEN floor(value)::BIGINT END AS v FROM events)
    SELECT event_id, v, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM e"""
    out["ref_smooth"] = f"SELECT vec_id, p, CASE WHEN p IN (0, 63) THEN px ELSE (lag(px) OVER w + 2 * px + lead(px) OVER w + 2) >> 2 END AS v FROM ({_PX}) WINDOW w AS (PARTITION BY vec_id ORDER BY p)"
    has = lambda dx, dy, bit: f"CASE WHEN x + {dx} >= 0 AND x + {dx} < 10 AND (SELECT count(*) FROM embeddings q WHERE q.vec_id = e.vec_id + {dx} + 10 * {dy}) > 0 THEN {bit} ELSE 0 END"
    out["neighbour_mask"] = f"SELECT vec_id, {' + '.join(has(dx, dy, 1 << i) for i, (dx, dy) in enumerate(((-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))))} AS mask FROM (SELECT vec_id, vec_id % 10 AS x FROM embeddings) e"
    grid = "SELECT vec_id, unnest([4, 8, 16, 32]) AS n, label * 11 % 35 AS mode FROM embeddings"
    out["mode_filter_flag"] = f"SELECT vec_id, n, mode, n > 4 AND mode != 1 AND (mode = 0 OR least(abs(mode - 10), abs(mode - 26)) > CASE n WHEN 8 THEN 7 WHEN 16 THEN 1 ELSE 0 END) AS smoothed FROM ({grid})"
    out["scan_choice"] = f"SELECT vec_id, n, mode, luma, CASE WHEN n = 4 OR (n = 8 AND luma) THEN CASE WHEN mode BETWEEN 22 AND 30 THEN 'hor' WHEN mode BETWEEN 6 AND 14 THEN 'ver' ELSE 'diag' END ELSE 'diag' END AS scan FROM ({grid}), (SELECT unnest([true, false]) AS luma)"
    out["mpm_candidates"] = f"{_LABELS} SELECT vec_id, c[1] AS c0, c[2] AS c1, c[3] AS c2 FROM c"
    out["mode_index"] = f"{_LABELS} SELECT vec_id, mode, {_IDX} AS idx FROM c"
    out["mode_bins"] = f"{_LABELS} SELECT vec_id, CASE idx WHEN 0 THEN '10' WHEN 1 THEN '110' WHEN 2 THEN '111' ELSE '0' || lpad(bin(idx - 3), 5, '0') END AS bins FROM (SELECT vec_id, {_IDX} AS idx FROM c)"
    out["pred_dc"], out["pred_planar"], out["pred_angular"] = (_digests((4, 8, 16, 32), f"mode {x}") for x in ("= 1", "= 0", "> 1"))
    out["pred_chroma"] = _digests((4, 8, 16), "mode IN (0, 1, 2, 10, 18, 26, 34)", chroma=True)
    out["mode_decision_luma"] = " UNION ALL ".join(map(_luma, (4, 8, 16, 32)))
    out["mode_decision_chroma"] = " UNION ALL ".join(map(_chroma, (4, 8, 16)))
    out["border_fill"] = " UNION ALL ".join(f"SELECT {n} AS n, blk, ll AS left_mode, tl AS top_mode, list_sum(r0)::BIGINT AS total, md5(array_to_string(r0, ',')) AS digest FROM (WITH {_predictions(n)} SELECT * FROM b6)" for n in (4, 8, 16, 32))
    step = "{0} AS (SELECT o.level, o.node, CASE WHEN c.n = 4 THEN least(cost, parts) ELSE cost END AS best, coalesce(c.n = 4 AND parts < cost, false) AS split FROM own o LEFT JOIN (SELECT node // 4 AS node, sum(best)::BIGINT AS parts, count(*) AS n FROM {1} GROUP BY 1) c ON c.node = o.node WHERE o.level = {2})"
    own = " UNION ALL ".join(f"SELECT {i} AS level, blk AS node, cost FROM ({_luma(n)})" for i, n in enumerate((4, 8, 16, 32)))
    out["quadtree_open_loop"] = f"WITH own AS ({own}), q0 AS (SELECT level, node, cost AS best, false AS split FROM own WHERE level = 0), {', '.join(step.format(f'q{i}', f'q{i - 1}', i) for i in (1, 2, 3))} " + " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(4))
    for n, sine in ((4, True), (4, False), (8, False), (16, False), (32, False)):
        name = ("dst" if sine else "dct") + str(n)
        out[name] = f"WITH {_forward(n, sine)} SELECT blk, y, x, c FROM f"
        out["i" + name] = f"WITH {_forward(n, sine)}, {_inverse('f')} SELECT blk, y, x, v FROM i"
    out["quantize"] = f"WITH {_forward(8)} " + " UNION ALL ".join(f"SELECT blk, {q} AS qp, y * 8 + x AS p, {_level(q)} AS level FROM f" for q in qps)
    lev = f"{_forward(8)}, lv AS (SELECT blk, y, x, {_level(32)} AS l FROM f)"
    out["dequantize"] = f"WITH {lev} SELECT blk, y * 8 + x AS p, {_dequantized(32)} AS c FROM lv"
    out["reconstruct"] = f"WITH {lev}, dq AS (SELECT blk, y, x, {_dequantized(32)} AS c FROM lv), {_inverse('dq')} SELECT blk, y * 8 + x AS p, least(255, greatest(0, 128 + v)) AS v FROM i"
    sums = lambda n, q: f"SELECT {n} AS n, blk, {q} AS qp, sum(abs({_level(q, n)}))::BIGINT AS total FROM (WITH {_forward(n)} SELECT * FROM f) GROUP BY blk"
    out["quantize_sums"] = " UNION ALL ".join(sums(n, q) for n in (4, 8, 16, 32) for q in qps)
    flag = lambda n: f"SELECT {n} AS n, blk, luma, coded, CASE WHEN luma AND {n} != 4 THEN 1 ELSE 0 END AS ctx FROM (SELECT blk, bool_or({_level(37, n)} != 0) AS coded FROM (WITH {_forward(n)} SELECT * FROM f) GROUP BY blk), (SELECT unnest([true, false]) AS luma)"
    out["coded_flag_contexts"] = " UNION ALL ".join(map(flag, (4, 8, 16, 32)))
    out["significance_contexts"] = f"""WITH {_forward(8)}, lv AS (SELECT blk, y, x, {_level(32)} AS l FROM f), gf AS (SELECT DISTINCT blk, y // 4 AS gy, x // 4 AS gx FROM lv WHERE l != 0),
      gp AS (SELECT g.*, CASE WHEN a.blk IS NULL THEN 0 ELSE 1 END + CASE WHEN b.blk IS NULL THEN 0 ELSE 2 END AS pattern FROM gf g LEFT JOIN gf a ON a.blk = g.blk AND a.gy = g.gy AND a.gx = g.gx + 1 LEFT JOIN gf b ON b.blk = g.blk AND b.gy = g.gy + 1 AND b.gx = g.gx),
      q AS (SELECT blk, pattern, (gx * 4 + i % 4)::INT AS x, (gy * 4 + i // 4)::INT AS y, kind, luma FROM gp, (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(['diag', 'hor', 'ver']) AS kind), (SELECT unnest([true, false]) AS luma))
    SELECT *, CASE WHEN x + y = 0 THEN 0 ELSE CASE WHEN luma AND x // 4 + y // 4 > 0 THEN 3 ELSE 0 END + CASE kind WHEN 'diag' THEN 9 ELSE 15 END
        + CASE pattern WHEN 0 THEN [2, 1, 1, 0, 0, 0, 0][x % 4 + y % 4 + 1] WHEN 1 THEN [2, 1, 0, 0][y % 4 + 1] WHEN 2 THEN [2, 1, 0, 0][x % 4 + 1] ELSE 2 END END AS ctx FROM q"""
    out["cbf_flags"] = f"WITH {_forward(8)} SELECT blk, bool_or({_level(37)} != 0) AS coded FROM f GROUP BY blk"
    scans = " UNION ALL ".join(_scan(8, k) for k in ("diag", "hor", "ver"))
    out["scan_order"] = f"WITH {lev}, sc AS ({scans}) SELECT blk, kind, pos::INT AS pos, l AS level FROM lv JOIN sc ON sc.y = lv.y AND sc.x = lv.x"
    last = f"WITH {lev}, sc AS ({_scan(8, 'diag')}), ls AS (SELECT blk, count(*) AS n_sig, max(pos) AS last_pos, arg_max(lv.y, pos) AS y, arg_max(lv.x, pos) AS x FROM lv JOIN sc ON sc.y = lv.y AND sc.x = lv.x WHERE l != 0 GROUP BY blk)"
    out["last_significant"] = f"{last} SELECT blk, n_sig, last_pos, y, x FROM ls"
    # groups 0-3 are single places, 4 is 4 and 5, 5 is 6 and 7
    code = "CASE WHEN {0} < 4 THEN repeat('1', {0}::INT) || '0' WHEN {0} < 6 THEN '11110' || ({0} - 4)::VARCHAR ELSE '11111' || ({0} - 6)::VARCHAR END"
    out["last_pos_bins"] = f"{last} SELECT blk, {code.format('x')} AS x_bins, {code.format('y')} AS y_bins FROM ls"
    out["cg_context"] = f"WITH {lev}, g AS (SELECT DISTINCT blk, y // 4 AS gy, x // 4 AS gx FROM lv WHERE l != 0) SELECT g.blk, g.gy, g.gx, CASE WHEN r.blk IS NULL THEN 0 ELSE 1 END + CASE WHEN w.blk IS NULL THEN 0 ELSE 2 END AS ctx FROM g LEFT JOIN g r ON r.blk = g.blk AND r.gy = g.gy AND r.gx = g.gx + 1 LEFT JOIN g w ON w.blk = g.blk AND w.gx = g.gx AND w.gy = g.gy + 1"
    out["context_init"] = "SELECT o_orderkey, value, qp, CASE WHEN s > 63 THEN (s - 64) * 2 + 1 ELSE (63 - s) * 2 END AS state FROM (SELECT *, least(126, greatest(1, (((value >> 4) * 5 - 45) * qp >> 4) + (value & 15) * 8 - 16)) AS s FROM (SELECT o_orderkey, (o_custkey % 256)::INT AS value, (o_orderkey % 52)::INT AS qp FROM orders))"
    out["exp_golomb"] = f"SELECT o_orderkey, {_UE.format('o_custkey')} AS ue, {_UE.format('(CASE WHEN s > 0 THEN 2 * s - 1 ELSE -2 * s END)')} AS se FROM (SELECT o_orderkey, o_custkey, o_custkey - 500 AS s FROM orders)"
    out["coeff_remain_code"] = """WITH o AS (SELECT o_orderkey, o_custkey % 300 AS v, (o_orderkey % 5)::INT AS k FROM orders), t AS (SELECT *, v // (1::BIGINT << k) AS pre, v - 2 * (1::BIGINT << k) AS e FROM o)
    SELECT o_orderkey, v, k, CASE WHEN pre < 3 THEN repeat('1', pre::INT) || '0' || CASE WHEN k = 0 THEN '' ELSE lpad(bin(v % (1::BIGINT << k)), k, '0') END
      ELSE repeat('1', length(bin(e)) - 1 - k + 3) || '0' || CASE WHEN length(bin(e)) = 1 THEN '' ELSE substr(bin(e), 2) END END AS code FROM t"""
    order = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    out["emulation_prevention"] = f"""WITH b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS i, CASE WHEN l_quantity < 30 THEN 0 ELSE l_linenumber END AS v FROM lineitem),
    z AS (SELECT *, sum(CASE WHEN v != 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM b),
    r AS (SELECT l_orderkey, run, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS zeros, max(i) AS last, count(*) AS n FROM z GROUP BY ALL),
    x AS (SELECT r.*, b.v AS nxt FROM r LEFT JOIN b ON b.l_orderkey = r.l_orderkey AND b.i = r.last + 1)
    SELECT l_orderkey, sum(n)::BIGINT AS n_bytes, sum(CASE WHEN zeros > 0 THEN (zeros - 1) // 2 + CASE WHEN zeros % 2 = 0 AND nxt IN (1, 2, 3) THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS inserts, max(CASE WHEN zeros > 0 AND nxt IS NULL THEN 1 ELSE 0 END) AS end_mark FROM x GROUP BY l_orderkey"""
    out["entry_points"] = f"""WITH t AS ({_TILES}), w AS (SELECT frame, max(tile) AS last, greatest({_BLEN.format('max(bytes) - 1')}, 1) AS width, count(*) AS n_tiles FROM t GROUP BY frame)
    SELECT w.frame, n_tiles, width, coalesce(string_agg(lpad(bin(bytes - 1), width::INT, '0'), '' ORDER BY tile) FILTER (tile < last), '') AS code FROM t JOIN w ON w.frame = t.frame GROUP BY w.frame, n_tiles, width"""
    bits = f"lpad(bin(CASE WHEN o_orderkey = 1 THEN 19 ELSE 1 END), 6, '0') || lpad(bin(o_orderkey % 256), 8, '0') || {_UE.format('(o_custkey % 7)')} || {_UE.format('(CASE WHEN s > 0 THEN 2 * s - 1 ELSE -2 * s END)')} || '11'"
    out["header_bits"] = f"SELECT o_orderkey AS frame, rpad(b, ((length(b) + 7) // 8 * 8)::INT, '0') AS bits FROM (SELECT o_orderkey, {bits} AS b FROM (SELECT *, o_custkey % 13 - 6 AS s FROM orders))"
    hexed = "array_to_string(list_transform(range(0, length(bits) // 8), lambda i: printf('%02X', list_sum(list_transform(range(0, 8), lambda j: substr(bits, i * 8 + j + 1, 1)::INT * (1 << (7 - j))))::INT)), '')"
    def protected(digits: str, source: str, key: str, start: str = "00000001") -> str:
        """Bytes one by one: a mark before each of at most 3 that follows two zeros."""
        step = "CASE WHEN right(a, 6) = '00 00 ' AND b <= '03' THEN a || '03 ' || b || ' ' ELSE a || b || ' ' END"
        return f"SELECT {key}, '{start}' || replace(list_reduce(list_prepend('', regexp_extract_all({digits}, '..')), lambda a, b: {step}), ' ', '') AS bytes FROM ({source})"

    out["header_bytes"] = protected(hexed, out["header_bits"], "frame")
    zero = "repeat('00', ({})::INT)"
    raw = f"printf('%02X', o_orderkey % 5) || {zero.format('o_orderkey % 9')} || printf('%02X', o_custkey % 6) || {zero.format('o_custkey % 4')} || printf('%02X', o_orderkey % 256) || '0000'"
    out["protect_bytes"] = protected(raw, "orders", "o_orderkey", "")
    close = "rpad({0} || '1', ((length({0}) + 8) // 8 * 8)::INT, '0')"
    sets = {
        "video": "'0011001000000001' || '000' || '00000' || '1' || '0' || '010' || '1' || '1' || '0'",
        "sequence": f"""'0011010000000001' || repeat('0', 64) || '1' || '1' || '010' || '000' || {_UE.format("(32 * (p_size + 1))")} || {_UE.format("(32 * (p_size % 17 + 1))")} || '0' || '110'
          || '00101' || '010' || '1110' || '1' || '011' || '1' || '00100' || '1' || '1' || '0100' || '010' || '0' || '010' || '1' || '1' || '100' || '1110'""",
        "picture": f"""'0011011000000001' || '11' || '01' || '111' || '000' || '11' || '000000'
          || CASE WHEN p_size % 6 = 0 THEN '00' ELSE '01' || {_UE.format("(p_size % 3)")} || {_UE.format("(p_size % 2)")} || '10' END || '0100' || '1' || '00'""",
    }
    for name, b in sets.items():
        whole = "b" if name == "video" else close.format("b")
        out[f"{name}_parameter_set"] = protected(hexed, f"SELECT p_partkey, {whole} AS bits FROM (SELECT p_partkey, {b} AS b FROM part)", "p_partkey")
    ue = lambda v: _UE.format(f"({v})")
    fields = f"{ue('32 * (p_size + 1)')} || {ue('32 * (p_size % 17 + 1)')} || CASE WHEN p_size % 6 != 0 THEN '1' ELSE '0' END || {ue('p_size % 3')} || {ue('p_size % 2')} || '11'"
    out["parameter_sets"] = f"SELECT p_partkey, rpad(b, ((length(b) + 7) // 8 * 8)::INT, '0') AS bits FROM (SELECT p_partkey, {fields} AS b FROM part)"
    out["chroma_qp"] = f"SELECT o_orderkey, qp, CASE WHEN qp < 30 THEN qp ELSE {_CHROMA_QP}[qp - 29] END AS chroma_qp FROM (SELECT o_orderkey, (o_orderkey % 52)::INT AS qp FROM orders)"
    out["chroma_mode_bins"] = f"{_LABELS} SELECT vec_id, ['100', '101', '110', '111', '0'][i % 5 + 1] AS bins FROM (SELECT vec_id, {_IDX} AS i FROM c)"
    out["segment_concat"] = "SELECT conv_id, count(*) AS segments, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes, md5(string_agg(coalesce(text, ''), '' ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id"
    out["topn_desc_with_index"] = "SELECT p_brand, place, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part) WHERE place <= 5"
    return out
