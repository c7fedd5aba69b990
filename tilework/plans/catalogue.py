"""All queries of the library by name, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import blocks as B
from ..operators import entropy as E
from ..operators import geometry as G
from ..operators import headers as H
from ..operators import neighbours as NB
from ..operators import predict as P
from ..operators import report as R
from ..operators import transform as T
from ..sources import rawplanar as RP
from ..sources import reports as W
from . import oracles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QPS = (22, 27, 32, 37)


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _px(s: SparkSession, d: str) -> DataFrame:
    return B.sample_blocks(_t(s, d, "embeddings"))


def _tiles(s: SparkSession, d: str) -> DataFrame:
    return R.tile_stats(_t(s, d, "lineitem"), _t(s, d, "orders"))


def _coefficients(s: SparkSession, d: str, n: int, sine: bool = False) -> DataFrame:
    return B.residual_blocks(_t(s, d, "embeddings"), n).withColumn("c", T.dct(F.col("r"), n, sine))


def _levels(s: SparkSession, d: str, qp: int = 32) -> DataFrame:
    return _coefficients(s, d, 8).select("blk", "r", T.quantize(F.col("c"), qp, 8).alias("level"))


@_query
def psnr_block_pairs(s, d):
    """Distortion between each block and the next."""
    e = B.sse(F.col("px"), F.col("nxt"))
    return B.pairs(_px(s, d).select("vec_id", "px")).select("vec_id", e.alias("sse")).withColumn("psnr", F.round(X.psnr(F.col("sse"), 64), 6))


@_query
def psnr_weighted_avg(s, d):
    """Mean decibels of three planes (blocks dealt to planes by number), and their weighted mean."""
    plane = F.when(F.col("vec_id") % 6 < 4, "y").when(F.col("vec_id") % 6 == 4, "cb").otherwise("cr")
    one = psnr_block_pairs(s, d).withColumn("plane", plane)
    mean = lambda p: F.round(F.avg(F.when(F.col("plane") == p, F.col("psnr"))), 4)
    return one.agg(mean("y").alias("y"), mean("cb").alias("cb"), mean("cr").alias("cr")).withColumn("mean", F.round(R.weighted_mean(F.col("y"), F.col("cb"), F.col("cr")), 4))


PLANAR = (32, 32)


def planar_frames(px: DataFrame, width: int, height: int, samples: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Planar frames of vectors of 64 samples (vec_id, px), whose bytes follow each other; missing vectors are 128 throughout."""
    many = width * height * 3 // 2 // 64
    digits = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.hex(samples(x).cast("long")), 2, "0")), "")
    parts = px.select(F.expr(f"vec_id div {many}").cast("int").alias("frame_no"), F.struct((F.col("vec_id") % many).cast("int").alias("v"), digits(F.col("px")).alias("h")).alias("part"))
    held = parts.groupBy("frame_no").agg(F.map_from_entries(F.collect_list("part")).alias("held"))
    grey = digits(F.array_repeat(F.lit(128), 64))
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.coalesce(F.try_element_at("held", i), grey)), "")
    return RP.planes(held.select("frame_no", F.unhex(whole).alias("data")), width, height)


def _frames(s: SparkSession, d: str, samples: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """24 vectors each are a planar frame of 32x32 samples; what the last one lacks is 128."""
    return planar_frames(_px(s, d), *PLANAR, samples)


@_query
def planar_psnr(s, d):
    """Planar frames and a coarser version of them, paired by number."""
    found = R.plane_report(_frames(s, d), _frames(s, d, lambda x: F.least(F.lit(255), F.floor(x / 6) * 6 + 3)))
    return found.select("frame_no", *[F.round(c, 6).alias(c) for c in ("psnr_y", "psnr_cb", "psnr_cr", "psnr")])


@_query
def planar_blocks(s, d):
    """Blocks of the luma planes of planar frames."""
    return RP.plane_blocks(_frames(s, d), "y", *PLANAR).select("frame_no", "bx", "by", *_digest(F.col("px")))


@_query
def distortion_report(s, d):
    """The report of planar frames: bytes stand for what the frames' tiles would take."""
    frames = planar_psnr(s, d).withColumn("bytes", F.col("frame_no") * 37 % 1000 + 500)
    return W.distortion_report(frames, 30).drop("place")


@_query
def rd_report(s, d):
    """A row per frame in KiB, and one of all frames in KiB per second."""
    frames = _tiles(s, d).groupBy("frame").agg(F.sum("bytes").alias("bytes"))
    rows = frames.select(F.lit("frame").alias("kind"), "frame", F.round(F.col("bytes") / 1024, 6).alias("kib"), F.lit(None).cast("double").alias("kib_per_s"))
    total = frames.agg(F.round(F.avg("bytes") * 30 / 1024, 6).alias("kib_per_s")).select(F.lit("avg").alias("kind"), F.lit(None).cast("long").alias("frame"), F.lit(None).cast("double").alias("kib"), "kib_per_s")
    return rows.unionByName(total)


@_query
def bytes_rollup(s, d):
    return R.bytes_rollup(_tiles(s, d))


@_query
def byte_rate(s, d):
    frames = _tiles(s, d).groupBy("year", "frame").agg(F.sum("bytes").alias("bytes"))
    return R.byte_rate(frames, 30, "year")


@_query
def stats_wide(s, d):
    return R.wide(_tiles(s, d), 7)


@_query
def tile_split_uniform(s, d):
    parts = B.dealt(_t(s, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size")), "p_partkey")
    parts = parts.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("parts"))
    return G.split_uniform(parts, F.col("p_size"), F.col("parts")).select("p_partkey", "k", "j", "start", "size")


@_query
def tile_bounds(s, d):
    return G.tile_bounds(tile_split_uniform(s, d).where("k = 3")).select("p_partkey", "j", "first_pel", "last_pel")


@_query
def largest_tile(s, d):
    return G.largest_tile(tile_split_uniform(s, d), "p_partkey", "k")


@_query
def block_address(s, d):
    e = _t(s, d, "events").select("event_id", (F.col("event_id") % 2040).alias("number"))
    x, y = G.block_start(F.col("number"), F.lit(60))
    return e.withColumns({"x": x, "y": y}).withColumn("back", G.block_number(F.col("x") + 5, F.col("y") + 7, F.lit(60)))


@_query
def blocks_in_tiles(s, d):
    tiles = _t(s, d, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("w"), (F.col("p_size") % 3 + 1).alias("h"), (F.col("p_size") % 7).alias("x0"), (F.col("p_size") % 5).alias("y0"))
    return G.blocks_in_tiles(tiles).select("p_partkey", "seq", "bx", "by", "is_last")


@_query
def zorder_xy(s, d):
    z = (F.col("event_id") % 64).cast("int")
    return _t(s, d, "events").select("event_id", X.morton_x(z).alias("x"), X.morton_y(z).alias("y"))


@_query
def bit_length(s, d):
    return _t(s, d, "orders").select("o_orderkey", X.bit_length(F.col("o_orderkey")).alias("bits"))


@_query
def block_explode(s, d):
    return B.cells(_px(s, d), "px", 8, "vec_id")


@_query
def sad_pairs(s, d):
    return B.pairs(_px(s, d).select("vec_id", "px")).select("vec_id", B.sad(F.col("px"), F.col("nxt")).alias("sad")).withColumn("mad", F.expr("sad div 64"))


@_query
def ref_fill(s, d):
    e = _t(s, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.floor("value").cast("long")).alias("v"))
    return NB.fill(e, "v", ["user_id"], ["ts", "event_id"]).select("event_id", "v", "filled")


@_query
def ref_smooth(s, d):
    return _px(s, d).select("vec_id", F.posexplode(NB.smooth(F.col("px"), 64)).alias("p", "v"))


@_query
def neighbour_mask(s, d):
    return NB.neighbour_mask(_t(s, d, "embeddings").select("vec_id"), "vec_id", 10)


def _sizes_and_modes(s: SparkSession, d: str) -> DataFrame:
    """vec_id, n, mode: each vector's mode (a spread of its label) in blocks of all sizes."""
    return _t(s, d, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, (4, 8, 16, 32)))).alias("n"), (F.col("label") * 11 % 35).cast("int").alias("mode"))


@_query
def mode_filter_flag(s, d):
    return _sizes_and_modes(s, d).withColumn("smoothed", NB.uses_smoothing(F.col("n"), F.col("mode")))


@_query
def scan_choice(s, d):
    luma = F.explode(F.array(F.lit(True), F.lit(False)))
    return _sizes_and_modes(s, d).withColumn("luma", luma).withColumn("scan", G.scan_kind(F.col("n"), F.col("mode"), F.col("luma")))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """Labels of the neighbours, spread over the modes, stand in for decided modes."""
    mode = (F.col("label") * 11 % 35).cast("int")
    e = _t(s, d, "embeddings").select("vec_id", mode.alias("mode"), (F.col("vec_id") % 10).alias("x"), F.expr("vec_id div 10").alias("y"))
    ref = lambda dx, dy, name: e.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("mode").alias(name))
    both = e.join(ref(1, 0, "left_mode"), ["x", "y"], "left").join(ref(0, 1, "top_mode"), ["x", "y"], "left")
    # the row above another tree block counts as absent
    both = both.withColumn("top_mode", F.when(F.col("y") % 4 != 0, F.col("top_mode")))
    return both.withColumn("cand", NB.probable_modes(F.col("left_mode"), F.col("top_mode")))


@_query
def mpm_candidates(s, d):
    c = F.col("cand")
    return _candidates(s, d).select("vec_id", F.get(c, F.lit(0)).alias("c0"), F.get(c, F.lit(1)).alias("c1"), F.get(c, F.lit(2)).alias("c2"))


@_query
def mode_index(s, d):
    return _candidates(s, d).select("vec_id", "mode", NB.mode_index(F.col("mode"), F.col("cand")).alias("idx"))


@_query
def mode_bins(s, d):
    return mode_index(s, d).select("vec_id", E.mode_bins(F.col("idx")).alias("bins"))


SIZES = (4, 8, 16, 32)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _grid(s: SparkSession, d: str, n: int, second: bool = False) -> DataFrame:
    """Blocks on a picture, with a spread of labels as their modes; of a second plane if asked for."""
    blocks = B.grid_blocks(_t(s, d, "embeddings"), n).withColumn("label", (F.col("label") * 11 % 35).cast("int"))
    return blocks.withColumn("px", F.transform("px", lambda x: (x * 5 + 77) % 256)) if second else blocks


def _digest(px: Column) -> list[Column]:
    """Sum of the samples and a digest of them in order."""
    return [F.aggregate(px, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.md5(F.array_join(px, ",")).alias("digest")]


def _prediction(s: SparkSession, d: str, modes: Sequence[int], sizes: Iterable[int] = SIZES, chroma: bool = False) -> DataFrame:
    def one(n: int) -> DataFrame:
        each = P.predicted(P.borders(_grid(s, d, n), n).select("n", "blk", "border"), modes, n, chroma)
        return each.select("n", "blk", "mode", *_digest(F.col("px")))

    return _union(map(one, sizes))


@_query
def border_fill(s, d):
    """Borders of blocks of all sizes, missing neighbours filled in, and the modes left and above."""
    return _union(P.borders(_grid(s, d, n), n).select("n", "blk", "left_mode", "top_mode", *_digest(F.col("border"))) for n in SIZES)


@_query
def pred_dc(s, d):
    return _prediction(s, d, [1])


@_query
def pred_planar(s, d):
    return _prediction(s, d, [0])


@_query
def pred_angular(s, d):
    """All directions."""
    return _prediction(s, d, range(2, 35))


@_query
def pred_chroma(s, d):
    """Without smoothing and filtered edges."""
    return _prediction(s, d, (0, 1, 2, 10, 18, 26, 34), (4, 8, 16), chroma=True)


@_query
def mode_decision_luma(s, d):
    return _union(P.decide(_grid(s, d, n), n) for n in SIZES)


@_query
def mode_decision_chroma(s, d):
    return _union(P.decide_chroma(_grid(s, d, n), _grid(s, d, n, second=True), P.decide(_grid(s, d, n), n), n) for n in (4, 8, 16))


@_query
def quadtree_open_loop(s, d):
    """Splits by the costs of the best modes, from blocks of 4 up to 32."""
    own = _union(P.decide(_grid(s, d, n), n).select(F.lit(i).alias("level"), F.col("blk").alias("node"), F.col("cost").cast("long").alias("cost")) for i, n in enumerate(SIZES))
    return P.quadtree(own, len(SIZES)).drop("leaf")


def _dct_query(n: int, sine: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        return B.cells(_coefficients(s, d, n, sine), "c", n, "blk")

    query.__name__ = ("dst" if sine else "dct") + str(n)
    return query


def _idct_query(n: int, sine: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        return B.cells(_coefficients(s, d, n, sine).withColumn("v", T.idct(F.col("c"), n, sine)), "v", n, "blk")

    query.__name__ = ("idst" if sine else "idct") + str(n)
    return query


for _n, _sine in ((4, True), (4, False), (8, False), (16, False), (32, False)):
    _query(_dct_query(_n, _sine))
    _query(_idct_query(_n, _sine))


@_query
def quantize(s, d):
    c = _coefficients(s, d, 8)
    each = F.array(*[F.struct(F.lit(q).alias("qp"), T.quantize(F.col("c"), q, 8).alias("level")) for q in QPS])
    return c.select("blk", F.explode(each).alias("x")).select("blk", "x.qp", F.posexplode("x.level").alias("p", "level"))


@_query
def quantize_sums(s, d):
    """Sums of levels for transforms of all sizes."""
    each = lambda n: _coefficients(s, d, n).select(F.lit(n).alias("n"), "blk", F.inline(F.array(*[F.struct(F.lit(q).alias("qp"), T.sum_of_levels(T.quantize(F.col("c"), q, n)).alias("total")) for q in QPS])))
    return _union(map(each, SIZES))


@_query
def dequantize(s, d):
    return _levels(s, d).select("blk", F.posexplode(T.dequantize(F.col("level"), 32, 8)).alias("p", "c"))


@_query
def reconstruct(s, d):
    """Blocks coded over a flat prediction of 128 and decoded again."""
    flat = F.transform("r", lambda x: F.lit(128))
    decoded = T.idct(T.dequantize(F.col("level"), 32, 8), 8)
    return _levels(s, d).select("blk", F.posexplode(T.reconstruct_or_predict(flat, F.col("level"), decoded)).alias("p", "v"))


@_query
def cbf_flags(s, d):
    return _levels(s, d, 37).select("blk", T.coded(F.col("level")).alias("coded"))


@_query
def scan_order(s, d):
    """Levels in the order of each scan."""
    order = G.scan_order(s, (8,)).select("kind", "pos", (F.col("y") * 8 + F.col("x")).cast("int").alias("p"))
    return _levels(s, d).select("blk", F.posexplode("level").alias("p", "level")).join(F.broadcast(order), "p").select("blk", "kind", "pos", "level")


@_query
def last_significant(s, d):
    return E.last_significant(_levels(s, d), G.scan_order(s, (8,)), 8)


@_query
def last_pos_bins(s, d):
    return last_significant(s, d).select("blk", E.last_position_bins(F.col("x"), 8).alias("x_bins"), E.last_position_bins(F.col("y"), 8).alias("y_bins"))


@_query
def cg_context(s, d):
    return E.group_flags(_levels(s, d), 8)


@_query
def significance_contexts(s, d):
    """Contexts of all places of the groups with levels, by the groups right and below, for every scan, luma and colour."""
    groups = E.group_flags(_levels(s, d), 8).withColumnRenamed("ctx", "pattern")
    at = groups.select("blk", "pattern", "gy", "gx", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    at = at.select("blk", "pattern", (F.col("gx") * 4 + F.col("i") % 4).cast("int").alias("x"), (F.col("gy") * 4 + F.expr("i div 4")).cast("int").alias("y"), F.explode(F.array(*map(F.lit, ("diag", "hor", "ver")))).alias("kind")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("luma"))
    return at.withColumn("ctx", E.significance_context(F.col("pattern"), F.col("kind"), F.col("x"), F.col("y"), F.lit(8), F.col("luma")))


@_query
def coded_flag_contexts(s, d):
    """Flags of the transform blocks of all sizes, with their contexts."""
    each = lambda n: _coefficients(s, d, n).select(F.lit(n).alias("n"), "blk", F.explode(F.array(F.lit(True), F.lit(False))).alias("luma"), T.coded(T.quantize(F.col("c"), 37, n)).alias("coded"))
    return _union(map(each, SIZES)).withColumn("ctx", E.coded_flag_context(F.col("n"), F.col("luma")))


@_query
def context_init(s, d):
    grid = _t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 256).cast("int").alias("value"), (F.col("o_orderkey") % 52).cast("int").alias("qp"))
    return grid.withColumn("state", E.context_state(F.col("value"), F.col("qp")))


@_query
def exp_golomb(s, d):
    o = _t(s, d, "orders")
    return o.select("o_orderkey", X.exp_golomb(F.col("o_custkey")).alias("ue"), X.signed_exp_golomb(F.col("o_custkey") - 500).alias("se"))


@_query
def coeff_remain_code(s, d):
    o = _t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 300).alias("v"), (F.col("o_orderkey") % 5).cast("int").alias("k"))
    return o.withColumn("code", X.remainder_code(F.col("v"), F.col("k")))


@_query
def emulation_prevention(s, d):
    byte = F.when(F.col("l_quantity") < 30, 0).otherwise(F.col("l_linenumber"))
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return E.emulation_inserts(_t(s, d, "lineitem").select("l_orderkey", *cols, byte.alias("byte")), ["l_orderkey"], cols, "byte")


@_query
def entry_points(s, d):
    return E.entry_points(_tiles(s, d), "frame", "tile", "bytes")


@_query
def header_bits(s, d):
    """Headers of frames: a type by whether it is the first, picture order in 8 bits, and three coded numbers."""
    o = _t(s, d, "orders").select(F.col("o_orderkey").alias("frame"), "o_custkey")
    f = lambda i, kind, value, bits: F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), value.cast("long").alias("value"), F.lit(bits).alias("bits"))
    fields = F.array(f(0, "u", F.when(F.col("frame") == 1, 19).otherwise(1), 6), f(1, "u", F.col("frame") % 256, 8), f(2, "ue", F.col("o_custkey") % 7, 0), f(3, "se", F.col("o_custkey") % 13 - 6, 0), f(4, "u", F.lit(1), 1))
    return E.header(o.select("frame", F.inline(fields)), "frame")


@_query
def header_bytes(s, d):
    """The same as bytes behind a start code."""
    return header_bits(s, d).select("frame", H.carried(F.col("bits")).alias("bytes"))


@_query
def protect_bytes(s, d):
    """Runs of zero bytes of all lengths, kept from looking like start codes."""
    o = _t(s, d, "orders").select("o_orderkey", "o_custkey")
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    k = F.col("o_orderkey")
    raw = F.concat(byte(k % 5), F.repeat(F.lit("00"), (k % 9).cast("int")), byte(F.col("o_custkey") % 6), F.repeat(F.lit("00"), (F.col("o_custkey") % 4).cast("int")), byte(k % 256), F.lit("0000"))
    return o.select("o_orderkey", X.protected_hex(raw).alias("bytes"))


def _streams(s: SparkSession, d: str) -> DataFrame:
    """Sizes of frames and tile grids of streams."""
    n = F.col("p_size").cast("long")
    return B.dealt(_t(s, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", (32 * (n + 1)).alias("width"), (32 * (n % 17 + 1)).alias("height"), F.lit(4).alias("poc_bits_less_4"), (n % 3).alias("cols_less_1"), (n % 2).alias("rows_less_1"))


@_query
def video_parameter_set(s, d):
    return _streams(s, d).select("p_partkey", H.video_set().alias("bytes"))


@_query
def sequence_parameter_set(s, d):
    return _streams(s, d).select("p_partkey", H.sequence_set().alias("bytes"))


@_query
def picture_parameter_set(s, d):
    return _streams(s, d).select("p_partkey", H.picture_set().alias("bytes"))


@_query
def parameter_sets(s, d):
    """Sizes and tile grids of streams as a header: width, height, tiles on or off, columns, rows, uniform."""
    p = _t(s, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    f = lambda i, kind, value, bits: F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), value.cast("long").alias("value"), F.lit(bits).alias("bits"))
    n = F.col("n")
    fields = F.array(f(0, "ue", 32 * (n + 1), 0), f(1, "ue", 32 * (n % 17 + 1), 0), f(2, "u", (n % 6 != 0).cast("int"), 1), f(3, "ue", n % 3, 0), f(4, "ue", n % 2, 0), f(5, "u", F.lit(1), 1))
    return E.header(p.select("p_partkey", F.inline(fields)), "p_partkey")


@_query
def chroma_qp(s, d):
    qp = (F.col("o_orderkey") % 52).cast("int")
    return _t(s, d, "orders").select("o_orderkey", qp.alias("qp"), X.chroma_qp(qp).alias("chroma_qp"))


@_query
def chroma_mode_bins(s, d):
    luma = mode_index(s, d).select("vec_id", (F.col("idx") % 5).alias("idx"))
    return luma.select("vec_id", E.chroma_mode_bins(F.col("idx")).alias("bins"))


@_query
def segment_concat(s, d):
    """Segments of each stream joined in order, with their number and bytes."""
    seg = _t(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    whole = seg.groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum(F.length("data")).alias("n_bytes"), F.array_sort(F.collect_list(F.struct("turn", "data"))).alias("a"))
    return whole.select("conv_id", "segments", "n_bytes", F.md5(F.unhex(F.array_join(F.transform("a", lambda x: F.hex(x["data"])), ""))).alias("digest"))


@_query
def topn_desc_with_index(s, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    return _t(s, d, "part").withColumn("place", F.row_number().over(w)).where("place <= 5").select("p_brand", "place", "p_partkey", "p_size")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.all_sql(QPS).items() if k in _QUERIES}
