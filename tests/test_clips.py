"""Clips of several frames and tiles: queries against SQL, and operators against plain versions."""

import glob
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tilework.operators import coefficients as C
from tilework.operators import entropy as E
from tilework.operators import predict as P
from tilework.operators import tree as TR
from tilework.plans import clips
from tilework.sources import rawplanar as RP
from tilework.sources import reports

SQL = clips.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(clips.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, clips.queries()[name], SQL[name])


def test_leaves_cover_each_tree_once(spark, sf_dir):
    seen = {}
    for r in clips.queries()["tree_leaves"](spark, sf_dir).collect():
        frame, by, bx = r.blk // 10_000, r.blk // 100 % 100 * r.n, r.blk % 100 * r.n
        for y in range(by, by + r.n, 4):
            for x in range(bx, bx + r.n, 4):
                seen[frame, y, x] = seen.get((frame, y, x), 0) + 1
    assert set(seen.values()) == {1} and len(seen) == len({k[0] for k in seen}) * 24 * 16


def _blocks(spark, rows):
    return spark.createDataFrame(rows, "frame int, tile int, place int, bx int, by int, blk long, label int, px array<int>")


def test_blocks_of_two_frames_at_one_place(spark):
    px = lambda v: [v] * 16
    rows = [(f, 0, x, x, 0, 10 * f + x, None, px(50 * f + x)) for f in (0, 1) for x in (0, 1)]
    out = {r.blk: (r.mask, r.border) for r in P.borders(_blocks(spark, rows), 4, ("frame", "tile"), "place").collect()}
    assert {k: v[0] for k, v in out.items()} == {0: 0, 1: 2, 10: 0, 11: 2}
    assert out[0][1] == [128] * 17 and out[1][1] == [0] * 17 and out[11][1] == [50] * 17
    with pytest.raises(Exception, match="two blocks lie at one place"):
        P.borders(_blocks(spark, rows), 4).collect()
    # a later block, and one of another tile, don't count
    rows = [(0, 0, 5, 0, 0, 1, None, px(9)), (0, 0, 3, 1, 0, 2, None, px(8)), (0, 1, 0, 0, 1, 3, None, px(7))]
    assert {r.blk: r["mask"] for r in P.borders(_blocks(spark, rows), 4, ("frame", "tile"), "place").collect()} == {1: 0, 2: 0, 3: 0}


def test_modes_of_enough_rounds_are_those_of_deciding_in_order(spark):
    rng = random.Random(2)
    n, w, h = 8, 8, 4
    key = lambda x, y: (x // 4) * 64 + sum(((x % 4 >> i & 1) << 2 * i) + ((y % 4 >> i & 1) << 2 * i + 1) for i in range(2)) * 4
    base = [[rng.randrange(256) for _ in range(8 * w)] for _ in range(8 * h)]
    rows = [(0, 0, key(x, y), x, y, y * w + x, key(x, y), [base[y * 8 + j][(x * 8 + i) // 3 * 3] for j in range(8) for i in range(8)]) for y in range(h) for x in range(w)]
    bordered = P.borders(_blocks(spark, rows), n, ("frame", "tile"), "place").withColumnRenamed("label", "place")
    got = {r.blk: (r.mode, r.cost) for r in P.decide_in_order(bordered, n, ("frame", "tile"), "place", rounds=12).collect()}
    borders = {r.blk: np.array([r.border]) for r in bordered.collect()}
    done = {}
    for _, _, _, x, y, blk, _, px in sorted(rows, key=lambda r: r[2]):
        a, b = done.get((x - 1, y), (1,))[0], done.get((x, y - 1), (1,))[0] if y % 4 else 1
        cand = [0, 1, 26] if a == b and a < 2 else [a, 2 + (a + 29) % 32, 2 + (a - 1) % 32] if a == b else [a, b, 0 if a and b else 1 if a != 1 and b != 1 else 26]
        sad = [int(np.abs(P.predict(borders[blk], m, n).reshape(-1) - np.array(px)).sum()) for m in range(35)]
        cost, mode = min((sad[m] + 32 * (1 if m == cand[0] else 2 if m in cand else 3), m) for m in range(35))
        done[x, y] = (mode, cost)
    assert got == {y * w + x: v for (x, y), v in done.items()}


def test_intervals_equal_loops(spark):
    rng = random.Random(5)
    spans = []
    for s in range(6):
        at = rng.randrange(3)
        for j in range(rng.randrange(1, 9)):
            size = rng.choice([0, 1, 2, 7, 40])
            spans.append((s, j, at, size))
            at += size + rng.choice([0, 0, 3])
    points = [(i, rng.randrange(7), rng.randrange(-5, 160)) for i in range(400)]
    expected = sorted((i, j) for i, s, x in points for t, j, at, size in spans if s == t and at <= x < at + size)
    for bucket in (1, 8, 64):
        got = TR.interval_of(spark.createDataFrame(points, "i int, s int, x int"), spark.createDataFrame(spans, "s int, j int, start int, size int"), "x", ["s"], bucket)
        assert sorted((r.i, r.j) for r in got.collect()) == expected


def test_planes_of_mixed_blocks_and_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    clip = rng.integers(0, 256, (3, 64 * 32 * 3 // 2), dtype=np.uint8)
    path = str(tmp_path / "clip.yuv")
    clip.tofile(path)
    spark.dataSource.register(RP.RawPlanar)
    frames = spark.read.format("rawplanar").option("width", 64).option("height", 32).load(path)
    planes = None
    for plane, w, h, sizes in (("y", 64, 32, (32, 16)), ("cb", 32, 16, (8, 4)), ("cr", 32, 16, (16, 16))):
        parts = []
        for half, n in enumerate(sizes):  # left half in one size, right half in another
            b = RP.plane_blocks(frames, plane, w, h, n).select("frame_no", (F.col("bx") * n).alias("x"), (F.col("by") * n).alias("y"), F.lit(n).alias("n"), "px")
            parts.append(b.where(f"x {'>=' if half else '<'} {w // 2}"))
        back = RP.planes_of_blocks(parts[0].unionByName(parts[1]), plane, w, h)
        planes = back if planes is None else planes.join(back, "frame_no")
    out = str(tmp_path / "back")
    planes.repartitionByRange(2, "frame_no").sortWithinPartitions("frame_no").write.format("rawplanar").option("path", out).mode("append").save()
    assert b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{out}/*"))) == clip.tobytes()
    with pytest.raises(Exception, match="leave samples"):
        RP.planes_of_blocks(parts[0], "cr", 32, 16).collect()


def test_only_wanted_frames_are_read(spark, tmp_path):
    frame = 32 * 32 * 3 // 2
    path = str(tmp_path / "clip.yuv")
    open(path, "wb").write(b"".join(bytes([i]) * frame for i in range(40)))
    reader = lambda *f: (r := RP._PruningReader(path, 32, 32, 4), list(r.pushFilters(list(f))), [(p.first, p.last) for p in r.partitions()])[1:]
    at = ("frame_no",)
    assert reader(RP.GreaterThanOrEqual(at, 6), RP.LessThan(at, 11)) == ([], [(6, 10), (10, 11)])
    assert reader(RP.EqualTo(at, 39)) == ([], [(39, 40)])
    assert reader(RP.GreaterThan(at, 39)) == ([], [(0, 0)])
    kept, parts = reader(RP.In(at, (3, 9)), RP.EqualTo(("y",), b"x"))
    assert len(kept) == 2 and parts == [(3, 7), (7, 10)]
    spark.dataSource.register(RP.RawPlanar)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("rawplanar").option("width", 32).option("height", 32).option("frames_per_task", 1).option("prune", True).load(path).where("frame_no between 7 and 9")
        assert df.rdd.getNumPartitions() == 3
        assert sorted((r.frame_no, r.y[0]) for r in df.collect()) == [(7, 7), (8, 8), (9, 9)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bits_become_bytes_across_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(s, g, i, "".join(rng.choice("01") for _ in range(rng.choice([0, 1, 3, 9, 40, 5000])))) for s in range(3) for g in range(0, 90, rng.choice([1, 3])) for i in range(rng.randrange(4))]
    df = spark.createDataFrame(rows, "s int, g int, i int, bits string")
    at = E.bit_offsets(df, ["s"], "g", [F.col("i")], "bits", bucket=8)
    out = E.packed(at, ["s"], "bits", 100)
    assert max(len(r.data) for r in out.collect()) == 100
    spark.dataSource.register(reports.ByteStream)
    for s in range(3):
        whole = "".join(b for t, _, _, b in sorted(rows) if t == s)
        path = str(tmp_path / f"s{s}")
        one = out.where(F.col("s") == s).select(F.col("chunk").cast("long").alias("number"), "data").repartitionByRange(3, "number").sortWithinPartitions("number")
        one.write.format("bytestream").option("path", path).mode("append").save()
        data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/*")))
        assert len(data) == -(-len(whole) // 8) > 1000
        assert "".join(f"{b:08b}" for b in data)[: len(whole)] == whole


def _plain_bins(level, n, scan, luma):
    """Bins of a block's groups as one string each, level by level with running state."""
    order = [level[p] for p in scan]
    last = max(i for i, v in enumerate(order) if v)
    w, c1, out = n // 4, 1, {}
    raster = [scan[g * 16] // n // 4 * w + scan[g * 16] % n // 4 for g in range(n * n // 16)]
    flags = {raster[g]: any(order[g * 16 : g * 16 + 16]) for g in range(n * n // 16)}
    for g in range(last // 16, -1, -1):
        text, found = "", []
        coded = g in (last // 16, 0) or flags[raster[g]]
        if g not in (last // 16, 0):
            text += str(int(flags[raster[g]]))
        for pos in range(min(last, g * 16 + 15), g * 16 - 1, -1):
            if coded and pos != last and (pos != g * 16 or g == 0 or found):
                text += str(int(order[pos] != 0))
            if order[pos]:
                found.append(order[pos])
        if found:
            c1, first = 1, None
            for v in found[:8]:
                text += str(int(abs(v) > 1))
                if abs(v) > 1:
                    c1, first = 0, first or abs(v)
            if first:
                text += str(int(first > 2))
            text += "".join(str(int(v < 0)) for v in found)
            rice, small = 0, 1
            if c1 == 0 or len(found) > 8:
                for i, v in enumerate(map(abs, found)):
                    base = 2 + small if i < 8 else 1
                    if v >= base:
                        rest = v - base
                        if rest < 3 << rice:
                            text += "1" * (rest >> rice) + "0" + (f"{rest % (1 << rice):0{rice}b}" if rice else "")
                        else:
                            size, rest = rice, rest - (3 << rice)
                            while rest >= 1 << size:
                                rest -= 1 << size
                                size += 1
                            text += "1" * (3 + size - rice) + "0" + (f"{rest:0{size}b}" if size else "")
                        rice = min(rice + 1, 4) if v > 3 << rice else rice
                    small = 0 if v >= 2 else small
        out[g] = text
    return out


def test_coefficient_bins_equal_a_coder_with_running_state(spark):
    rng = random.Random(6)
    scans = {(r.n, r.kind): r.scan for r in C.scan_arrays(spark).collect()}
    rows = []
    for k in range(120):
        n = rng.choice([4, 8, 16, 32])
        density, most = rng.choice([0.02, 0.2, 0.9]), rng.choice([1, 3, 60, 30_000])
        level = [rng.randint(-most, most) if rng.random() < density else 0 for _ in range(n * n)]
        rows.append((k, n, rng.randrange(35), rng.random() < 0.5 or n == 32, level))
    rows.append((999, 8, 0, True, [0] * 64))
    got = {}
    for r in C.coefficient_bins(spark.createDataFrame(rows, "k int, n int, mode int, luma boolean, level array<int>"), "k").orderBy("k", F.desc("grp"), "ord").collect():
        assert r.ctx is None or len(r.ctx) == len(r.bins)
        if r.grp < 1024:
            got[r.k, r.grp] = got.get((r.k, r.grp), "") + r.bins
    expected = {}
    for k, n, mode, luma, level in rows:
        if any(level):
            small = n in (4, 8) if luma else n == 4
            kind = "hor" if small and abs(mode - 26) < 5 else "ver" if small and abs(mode - 10) < 5 else "diag"
            expected |= {(k, g): t for g, t in _plain_bins(level, n, scans[n, kind], luma).items() if t}
    assert got == expected


def test_bins_are_dealt_to_rows_from_columns(spark):
    """Lambdas within a generator are evaluated without compiled code, and anew for each row that it gives."""
    df = spark.createDataFrame([(1, 4, 0, True, [1] * 16)], "k int, n int, mode int, luma boolean, level array<int>")
    plan = C.coefficient_bins(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    inline = next(x for x in plan.splitlines() if "Generate inline(" in x)
    assert "lambda" not in inline and "CASE" not in inline


def test_bins_of_odd_blocks(spark):
    """A block without levels has no rows, one whose luma isn't known is as colour; a level that isn't known has no bin, but a context."""
    level = [5, -1, 0, 0, 2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    empty = [(1, 4, 0, True, [0] * 16), (2, 4, 0, True, None), (3, 4, 0, True, []), (4, None, 0, True, level), (5, 5, 0, True, level), (6, 4, 0, True, [None] * 16)]
    rows = [(7, 4, 0, True, level), (8, 4, 0, False, level), (9, 4, None, None, level), (10, 4, 0, None, level), (10, 4, 0, None, level), (None, 4, 0, False, level), (11, 4, 0, True, [5, None, *level[2:]])]
    bins: dict = {}
    for r in C.coefficient_bins(spark.createDataFrame(empty + rows, "k int, n int, mode int, luma boolean, level array<int>"), "k").orderBy(F.desc("grp"), "ord").collect():
        bins.setdefault(r.k, []).append((r.grp, r.ord, r.element, r.bins, r.ctx))
    assert set(bins) == {7, 8, 9, 10, 11, None}
    assert bins[9] == bins[8] == bins[None] == bins[10][::2] == bins[10][1::2] != bins[7]  # a row that comes twice counts twice
    own = {e: (b, c) for _, _, e, b, c in bins[11]}
    assert own["significant"] == ("000011", [7, 4, 3, 6, 1, 2, 0])
    assert own["sign"] == ("000", None) and own["over_one"] == ("011", [1, 2, 0])


def test_intermediate_results_go_with_the_session(tmp_path):
    code = f"""
import os
from pyspark.sql import SparkSession
from tilework.sources.scratch import settled, shared_dir
named = {str(tmp_path / "own")!r}
for again in range(2):
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", named).getOrCreate()
    df = settled(spark.range(10), "numbers")
    assert shared_dir(spark) == named and df.count() == 10 and [x for x in os.listdir(named) if x.startswith("numbers")]
    spark.stop()
    assert not [x for x in os.listdir(named) if x.startswith("numbers")]
print("gone")
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert found.stdout.strip().endswith("gone"), found.stderr[-2000:]
