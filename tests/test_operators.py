import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilework import params
from tilework.functions import exprs as X
from tilework.operators import entropy as E
from tilework.operators import neighbours as NB
from tilework.operators import predict as P
from tilework.operators import report
from tilework.operators import transform as T
from tilework.sources import rawplanar, reports
from tilework.streaming import frames


def test_parameters():
    path, p = params.parse("-i clip.yuv -w 352 -ht 288 --qp 60 --fps 0 --tiles 2 2".split())
    assert (path, p.qp, p.fps, p.frame_bytes) == ("clip.yuv", 32, 30, 352 * 288 * 3 // 2)
    for bad in ({"width": 100, "height": 64}, {"width": 64, "height": 64, "tile_cols": 3}, {"width": 64, "height": 64, "frames": 0}):
        with pytest.raises(ValueError):
            params.VideoParameters(**bad)


@settings(max_examples=30, deadline=None)
@given(st.sampled_from([4, 8, 16, 32]), st.integers(0, 2**32 - 1))
def test_inverse_transform_comes_back(n, seed):
    r = np.random.default_rng(seed).integers(-255, 256, (3, n, n))
    assert np.abs(T.inverse(T.forward(r)) - r).max() <= 4
    if n == 4:
        assert np.abs(T.inverse(T.forward(r, True), True) - r).max() <= 4


def test_matrix_rows_are_nearly_orthogonal():
    for n in (4, 8, 16, 32):
        m = T.matrix(n)
        g = m @ m.T
        assert np.abs(g - np.diag(np.diag(g))).max() <= 64 * n // 2
        assert np.abs(np.diag(g) - 4096 * n).max() <= 4096


def test_quantizer_bounds(spark):
    # at QP 4 a level of an 8x8 block is worth 16
    rows = spark.createDataFrame([([*range(-32, 32)],)], "c array<int>").withColumn("l", T.quantize(F.col("c"), 4, 8)).withColumn("d", T.dequantize(F.col("l"), 4, 8)).first()
    assert all(abs(a - b) < 16 for a, b in zip(rows.c, rows.d, strict=True))


def _decode_ue(bits):
    zeros = bits.index("1")
    return int(bits[zeros : 2 * zeros + 1], 2) - 1


def test_exp_golomb_decodes(spark):
    rows = spark.range(-40, 1000).select("id", X.exp_golomb(F.abs("id")).alias("ue"), X.signed_exp_golomb(F.col("id")).alias("se")).collect()
    for r in rows:
        assert _decode_ue(r.ue) == abs(r.id)
        v = _decode_ue(r.se)
        assert (v + 1 >> 1 if v % 2 else -(v >> 1)) == r.id


def test_remainder_code_decodes(spark):
    def decode(bits, k):
        ones = bits.index("0")
        rest = bits[ones + 1 :]
        if ones < 3:
            return (ones << k) + int(rest or "0", 2)
        size = k + ones - 3
        return int(rest or "0", 2) + (1 << size) - (1 << k) + (3 << k)

    rows = spark.range(600).crossJoin(spark.range(5).toDF("k")).select("id", F.col("k").cast("int").alias("k"), X.remainder_code(F.col("id"), F.col("k").cast("int")).alias("code")).collect()
    assert all(decode(r.code, r.k) == r.id for r in rows)


def test_emulation_prevention_against_a_byte_loop(spark):
    rng = np.random.default_rng(5)
    streams = [rng.choice([0, 0, 0, 1, 3, 4, 9], rng.integers(1, 12)).tolist() for _ in range(300)]

    def loop(data):
        n = zeros = 0
        for b in data:
            if zeros == 2 and b <= 3:
                n, zeros = n + 1, 0
            zeros = zeros + 1 if b == 0 else 0
        return n, int(data[-1] == 0)

    df = spark.createDataFrame([(i, j, b) for i, s in enumerate(streams) for j, b in enumerate(s)], "s int, i int, b int")
    for r in E.emulation_inserts(df, ["s"], ["i"], "b").collect():
        assert (r.inserts, r.end_mark) == loop(streams[r.s])


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_prediction_of_simple_borders(n):
    flat = np.full((1, 4 * n + 1), 77)
    assert all((P.predict(flat, m, n, chroma) == 77).all() for m in range(P.MODES) for chroma in (False, True))
    border = np.arange(4 * n + 1)[None, :] % 251
    assert (P.predict(border, 26, n)[0, :, 1:] == border[0, 2 * n + 2 : 3 * n + 1]).all()
    assert (P.predict(border, 10, n)[0, 1:, :] == border[0, 2 * n - 2 : n - 1 : -1][:, None]).all()
    # colour planes keep the first column and row as they are
    assert (P.predict(border, 26, n, True)[0] == border[0, 2 * n + 1 : 3 * n + 1]).all()
    assert len(np.unique(P.predict(border, 1, n, True))) == 1


def plain_border(picture, x, y, n):
    """Samples around the block at (x, y) of a dict of blocks, filled in sample by sample."""
    at = [(n * x - 1, n * y + 2 * n - 1 - i) for i in range(2 * n)] + [(n * x - 1 + i, n * y - 1) for i in range(2 * n + 1)]
    there = [picture[px // n, py // n][py % n, px % n] if (px // n, py // n) in picture else None for px, py in at]
    first = next((v for v in there if v is not None), 128)
    out = []
    for v in there:
        out.append(int(v) if v is not None else out[-1] if out else first)
    return out


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_borders_against_a_loop_over_samples(spark, n):
    """Blocks at edges, holes and blocks without any neighbour."""
    r = np.random.default_rng(n)
    places = [(x, y) for x in range(4) for y in range(3) if r.random() < 0.7] + [(9, 9)]
    picture = {p: r.integers(0, 256, (n, n)) for p in places}
    labels = {p: int(r.integers(0, 35)) for p in places}
    df = spark.createDataFrame([(i, *p, labels[p], picture[p].reshape(-1).tolist()) for i, p in enumerate(places)], "blk long, bx long, by long, label int, px array<int>")
    found = P.borders(df, n).collect()
    assert len(found) == len(places)
    for f in found:
        x, y = places[f.blk]
        assert f.border == plain_border(picture, x, y, n) and f.px == picture[x, y].reshape(-1).tolist()
        assert f.left_mode == labels.get((x - 1, y)) and f.top_mode == (labels.get((x, y - 1)) if y * n % 32 else None)


def test_protected_bytes_against_a_byte_loop(spark):
    rng = np.random.default_rng(6)
    streams = [rng.choice([0, 0, 0, 1, 2, 3, 4, 255], rng.integers(0, 14)).astype(np.uint8).tobytes() for _ in range(300)]

    def loop(data):
        out = bytearray()
        for b in data:
            if out[-2:] == b"\0\0" and b <= 3:
                out.append(3)
            out.append(b)
        return bytes(out)

    df = spark.createDataFrame([(i, s.hex()) for i, s in enumerate(streams)], "i int, h string").select("i", X.protected_hex(F.col("h")).alias("h"))
    assert all(bytes.fromhex(x.h) == loop(streams[x.i]) for x in df.collect())


def test_chroma_qp_never_falls(spark):
    qps = [x[0] for x in spark.range(52).select(X.chroma_qp(F.col("id").cast("int"))).collect()]
    assert qps[:30] == [*range(30)] and qps[51] == 39 and qps == sorted(qps)


def test_report_and_stream_sinks(spark, tmp_path):
    table = spark.createDataFrame([(i, 1000 + i, 30.5 + i, 40.0, None) for i in range(40)], "frame_no int, bytes long, psnr_y double, psnr_cb double, psnr_cr double")
    rows = reports.distortion_report(table, 25)
    reports.write_tabs(rows, str(tmp_path / "rd"), ["place"])
    (part,) = (tmp_path / "rd").glob("part-*")
    lines = [x.split("\t") for x in part.read_text().splitlines()]
    assert lines[0][:3] == ["frame", "kib", "psnr_y"] and [x[0] for x in lines[1:]] == [*map(str, range(40)), "avg"] and lines[-1][1:5] == [str(round(1019.5 * 25 / 1024, 6)), "50.0", "40.0", ""]
    reports.write_tabs(rows, str(tmp_path / "many"), ["place"], files=3, header=False)
    assert [x.split("\t")[0] for p in sorted((tmp_path / "many").glob("part-*")) for x in p.read_text().splitlines()] == [*map(str, range(40)), "avg"]

    spark.dataSource.register(reports.ByteStream)
    segments = [bytes([i]) * (i % 7) for i in range(30)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(segments)], "number long, data binary")
    out = tmp_path / "stream"
    df.repartitionByRange(4, "number").sortWithinPartitions("number").write.format("bytestream").mode("append").save(str(out))
    assert b"".join(p.read_bytes() for p in sorted(out.glob("segments-*"))) == b"".join(segments)
    with pytest.raises(Exception, match="exists"):
        df.write.format("bytestream").mode("append").save(str(out))


def test_overwriting_leaves_nothing_of_a_longer_clip(spark, tmp_path):
    spark.dataSource.register(rawplanar.RawPlanar)
    out = tmp_path / "clip"

    def write(n):
        df = spark.createDataFrame([(i, bytes([i]) * 64, b"c" * 16, b"d" * 16) for i in range(n)], rawplanar.SCHEMA)
        df.repartitionByRange(3, "frame_no").sortWithinPartitions("frame_no").write.format("rawplanar").option("width", 8).option("height", 8).mode("overwrite").save(str(out))
        return b"".join(bytes([i]) * 64 + b"c" * 16 + b"d" * 16 for i in range(n))

    for n in (9, 4, 7):
        expected = write(n)
        assert b"".join(p.read_bytes() for p in sorted(out.iterdir())) == expected


def test_mode_index_is_one_to_one(spark):
    modes = spark.range(35).select(F.col("id").cast("int").alias("mode"))
    for left, top in ((None, None), (0, 0), (26, 26), (10, 34), (2, 2), (1, 0)):
        c = NB.probable_modes(F.lit(left).cast("int"), F.lit(top).cast("int"))
        got = sorted(r[0] for r in modes.select(NB.mode_index(F.col("mode"), c)).collect())
        assert got == [*range(35)]


def test_raw_planar_round_trip(spark, tmp_path):
    w, h, n = 64, 32, 5
    data = np.random.default_rng(1).integers(0, 256, n * w * h * 3 // 2, dtype=np.uint8)
    clip = tmp_path / "clip.yuv"
    clip.write_bytes(data.tobytes())
    spark.dataSource.register(rawplanar.RawPlanar)
    df = spark.read.format("rawplanar").option("width", w).option("height", h).option("frames_per_task", 2).load(str(clip))
    assert df.count() == n and df.rdd.getNumPartitions() == 3
    df.repartitionByRange(2, "frame_no").sortWithinPartitions("frame_no").write.format("rawplanar").option("width", w).option("height", h).mode("append").save(str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("frames-*"))) == data.tobytes()
    again = rawplanar.read_frames(spark, str(clip), w, h)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    block = rawplanar.plane_blocks(again, "y", w, h).where("frame_no = 1 and bx = 2 and by = 1").first()
    frame = data[w * h * 3 // 2 :][: w * h].reshape(h, w)
    assert block.px == frame[8:16, 16:24].reshape(-1).tolist()
    clip.write_bytes(data.tobytes()[:-7])
    with pytest.raises(Exception, match="ends within a frame"):
        spark.read.format("rawplanar").option("width", w).option("height", h).load(str(clip)).count()


def test_plane_report(spark):
    r = np.random.default_rng(4)
    a = [r.integers(0, 256, n, dtype=np.uint8) for n in (64, 16, 16)]
    b = [x.copy() for x in a]
    b[0][5] ^= 1
    b[1][3] ^= 3
    df = lambda x: spark.createDataFrame([(0, *(bytes(p) for p in x))], rawplanar.SCHEMA)
    row = report.plane_report(df(a), df(b)).first()
    gone = report.plane_report(df(a).withColumn("cb", F.lit(None).cast("binary")), df(b)).first()
    assert gone.psnr_cb is None and gone.psnr_y == row.psnr_y
    assert abs(row.psnr_y - 10 * np.log10(65025 * 64)) < 1e-9 and row.psnr_cr is None and row.psnr is None
    assert abs(row.psnr_cb - 10 * np.log10(65025 * 16 / int((int(a[1][3]) - int(b[1][3])) ** 2))) < 1e-9


def test_stream_of_tiles(spark, tmp_path):
    spark.sql("SELECT id % 3 AS gop, id AS frame, 0 AS tile, id * 10 AS bytes FROM range(30)").repartition(3).write.parquet(str(tmp_path / "in"))
    q = frames.gop_totals(frames.tile_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("gops").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("gops").collect())) == sorted(map(tuple, frames.gop_totals(spark.read.parquet(str(tmp_path / "in"))).collect()))


def test_predictions_of_many_modes_are_rows_of_one_each(spark):
    """A row with all modes of a block of 32 took 132 KB, a batch of them gigabytes."""
    rng = np.random.default_rng(3)
    borders = rng.integers(0, 256, (70, 129)).astype(int)
    df = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(borders)], "blk long, border array<int>")
    found = P.predicted(df, range(2, 35), 32)
    assert dict(found.dtypes)["px"] == "array<int>"
    rows = found.collect()
    assert len(rows) == 70 * 33
    for r in rows[:: 97]:
        assert r.px == P.predict(borders[r.blk : r.blk + 1], r.mode, 32).reshape(-1).tolist()
    assert [x for lot in P._lots(700, 1024) for x in range(700)[lot]] == [*range(700)]


def test_transforms_work_in_lots():
    """Memory beyond input and output doesn't follow the number of blocks."""
    import tracemalloc

    x = np.random.default_rng(4).integers(-255, 256, (4_000, 32, 32)).astype(np.int32)
    tracemalloc.start()
    y = T.in_lots(T.forward, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < y.nbytes + 24e6
    assert (y[::500] == T.forward(x[::500].astype(np.int64))).all()
    assert T.in_lots(T.forward, x[:0]).shape == (0, 32, 32)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bits_of_known_fields_are_one_string_and_digits_come_by_words(spark):
    from tilework.operators import headers as H

    assert str(H.bits(H.SEQUENCE)).count("bin(") <= 6 and H._fixed("ue", 4) == "00101" and H._fixed("se", -2) == "00101" and H._fixed("u5", 3) == "00011"
    texts = ["".join(map(str, np.random.default_rng(i).integers(0, 2, 8 * i))) for i in range(40)]
    found = spark.createDataFrame([(t,) for t in texts], "b string").select("b", X.bits_to_hex(F.col("b")).alias("h")).collect()
    assert all(r.h == "".join(f"{int(r.b[i : i + 8], 2):02X}" for i in range(0, len(r.b), 8)) for r in found)


def test_rows_are_dealt_before_they_grow_or_are_summed(spark, sf_dir):
    """Else the task that reads a small file holds the groups of all of it."""
    from tilework.plans import catalogue

    plan = _plan(catalogue.largest_tile(spark, sf_dir))
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    plan = _plan(catalogue.stats_wide(spark, sf_dir))
    assert "pivot" not in plan and "hashpartitioning(l_orderkey" in plan
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning(l_orderkey")


def test_intervals_are_not_broadcast(spark, sf_dir):
    from tilework.plans import clips

    assert "Broadcast" not in _plan(clips.tiles_of_blocks(spark, sf_dir))


def test_bins_are_made_once(spark, sf_dir):
    """Their offsets and their bytes come from the same stored rows; and levels aren't transformed for brightness and colour apart."""
    from tilework.plans import clips

    assert "ArrowEvalPython" not in _plan(clips.packed_bins(spark, sf_dir))
    plan = clips._levels(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("ArrowEvalPython")


def test_only_what_leaves_an_area_is_moved_beside_blocks(spark):
    """Borders across areas, left of and above the first place too; samples for places of a block's own area are cut after it has moved."""
    r = np.random.default_rng(3)
    places = [(x, y) for x in (-17, -16, -1, 0, 14, 15, 16, 17, 31, 32) for y in (-1, 0, 15, 16, 17) if r.random() < 0.8]
    picture = {p: r.integers(0, 256, (4, 4)) for p in places}
    rows = [(i, *p, i % 35, picture[p].reshape(-1).tolist()) for i, p in enumerate(places)]
    rows.append((999, None, 3, None, [7] * 16))  # at no place that others know; it meets itself alone
    found = P.borders(spark.createDataFrame(rows, "blk long, bx long, by long, label int, px array<int>"), 4)
    plan = _plan(found)
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(__area_x" in plan
    assert plan.index("Generate") < plan.index("Exchange") < plan.rindex("Generate")  # from the last step to the first
    got = {f.blk: f for f in found.collect()}
    assert len(got) == len(rows) and got[999].left_mode is None and set(got[999].border) == {7}
    for i, (x, y) in enumerate(places):
        assert got[i].border == plain_border(picture, x, y, 4)


def test_levels_of_bins_are_made_once(spark, sf_dir):
    """A filter on levels goes down to where they are made, and has blocks transformed once for itself."""
    from tilework.plans import clips

    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert count(clips.coefficient_bins(spark, sf_dir)) == count(clips._levels(spark, sf_dir)) == 4


def test_vectors_are_dealt_before_their_bins_are_made(spark, sf_dir):
    """Else a small file's vectors are all worked on by the one task that reads it."""
    from tilework.plans import clips

    assert clips._levels(spark, sf_dir).where("n in (4, 8)").rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
