"""Queries over a clip of several frames and tiles: 144 vectors are the bytes of a planar frame of 96x64 samples, in two columns of tiles; what the last frame lacks is 128."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import coefficients as C
from ..operators import entropy as E
from ..operators import geometry as G
from ..operators import neighbours as NB
from ..operators import predict as P
from ..operators import report as R
from ..operators import transform as T
from ..operators import tree as TR
from ..sources import rawplanar as RP
from ..sources.scratch import settled
from . import clip_oracles
from .catalogue import SIZES, planar_frames

WIDTH, HEIGHT, COLUMNS, ROWS, QP, ROUNDS = 96, 64, 2, 1, 32, 3
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _digest(px: Column) -> list[Column]:
    return [F.aggregate(px, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.md5(F.array_join(px, ",")).alias("digest")]


def frames(s: SparkSession, d: str) -> DataFrame:
    return planar_frames(B.sample_blocks(_t(s, d, "embeddings")), WIDTH, HEIGHT)


def _grid(s: SparkSession, blocks: int, tiles: int) -> DataFrame:
    return G.split_uniform(s.range(1).select(F.lit(1).alias("one")), F.lit(blocks), F.lit(tiles))


def _blocks(s: SparkSession, d: str, n: int, plane: str = "y") -> DataFrame:
    """frame_no, tile, place, bx, by, blk (frame, row and column as a number), label (none), px of the blocks of a plane; of colour planes n is half of luma's."""
    scale = 1 if plane == "y" else 2
    px = RP.plane_blocks(frames(s, d), plane, WIDTH // scale, HEIGHT // scale, n)
    blk = (F.col("frame_no") * 10_000 + F.col("by") * 100 + F.col("bx")).cast("long")
    px = px.select("frame_no", "bx", "by", blk.alias("blk"), F.lit(None).cast("int").alias("label"), "px")
    return TR.coding_order(px, n * scale, _grid(s, WIDTH // P.CTU, COLUMNS), _grid(s, HEIGHT // P.CTU, ROWS))


TILE = ("frame_no", "tile")


def _bordered(s: SparkSession, d: str, n: int, plane: str = "y") -> DataFrame:
    blocks = _blocks(s, d, n, plane)
    # the place in coding order comes along as the block's label
    return P.borders(blocks.withColumn("label", F.col("place").cast("int")), n, TILE, "place").withColumnRenamed("label", "place")


@_query
def tiles_of_blocks(s, d):
    """The tile of each event's block in the grid of its stream: column and row by joins of places with intervals."""
    streams = _t(s, d, "part").select(F.col("p_partkey").alias("stream"), (F.col("p_size") + 3).cast("int").alias("across"), (F.col("p_size") % 9 + 2).cast("int").alias("down"), (F.col("p_size") % 4 + 1).cast("int").alias("cols"), (F.col("p_size") % 2 + 1).cast("int").alias("rows"))
    many = _t(s, d, "part").agg(F.max("p_partkey")).first()[0]
    events = _t(s, d, "events").select("event_id", (F.col("event_id") * 7 % many + 1).alias("stream")).join(streams.hint("merge"), "stream")
    events = events.select("event_id", "stream", (F.col("event_id") * 13 % F.col("across")).alias("x"), (F.col("event_id") * 5 % F.col("down")).alias("y"))
    axis = lambda n, k, name: G.split_uniform(streams.select("stream", n, k), F.col(n), F.col(k)).select("stream", F.col("j").alias(f"tile_{name}"), F.col("start").alias(f"{name}0"), F.col("size").alias(f"{name}_size")).hint("merge")
    # merged: intervals are many times the file whose size Spark goes by when it broadcasts
    at = TR.interval_of(events, axis("across", "cols", "x"), "x", ["stream"], first="x0", size="x_size")
    at = TR.interval_of(at, axis("down", "rows", "y"), "y", ["stream"], first="y0", size="y_size")
    return at.select("event_id", "stream", "tile_x", "tile_y", (F.col("x") - F.col("x0")).alias("x_in_tile"), (F.col("y") - F.col("y0")).alias("y_in_tile"))


@_query
def tile_order(s, d):
    """Tile and place in coding order of the blocks of all sizes."""
    return _union([_blocks(s, d, n).select(F.lit(n).alias("n"), "frame_no", "bx", "by", "tile", "place") for n in SIZES])


@_query
def tile_borders(s, d):
    """Borders of luma blocks of all sizes from what is in the same frame and tile and coded before, and which neighbours that are."""
    return _union([_bordered(s, d, n).select("n", "blk", "tile", "mask", *_digest(F.col("border"))) for n in SIZES])


def _decided(s: SparkSession, d: str, n: int) -> DataFrame:
    return P.decide_in_order(_bordered(s, d, n), n, TILE, "place", QP, ROUNDS)


@_query
def tile_modes(s, d):
    """Modes of luma blocks of all sizes, biased by the modes decided around them."""
    return _union([_decided(s, d, n).select("n", "blk", "mode", "cost") for n in SIZES])


def _node(n: int) -> Column:
    """Number of a block among those of its size, so that four of them make one of the next size with a fourth of it."""
    per, across = P.CTU // n, WIDTH // P.CTU
    tree = (F.col("frame_no") * (HEIGHT // P.CTU) + F.expr(f"by div {per}")) * across + F.expr(f"bx div {per}")
    return (tree * per * per + TR.z_order(F.col("bx") % per, F.col("by") % per)).cast("long")


def _leaves(s: SparkSession, d: str) -> DataFrame:
    """Leaves of the trees of least cost: level, node, n, blk, place, mode, best."""
    modes = _union([_decided(s, d, n).select("n", "blk", "place", "mode", "cost", F.lit(i).alias("level"), _node(n).alias("node")) for i, n in enumerate(SIZES)])
    return P.quadtree(modes, len(SIZES), "n", "blk", "place", "mode").where("leaf")


@_query
def tree_leaves(s, d):
    """Leaves of the trees of least cost, which cover each tree block once."""
    return _leaves(s, d).select("n", "blk", "place", "mode", F.col("best").alias("cost"))


@_query
def colour_blocks(s, d):
    """Colour blocks of the leaves: four luma leaves of 4 share one, which takes the first one's mode."""
    return TR.colour_areas(_leaves(s, d))


def _coded(s: SparkSession, d: str) -> DataFrame:
    """The leaves with their prediction, levels and reconstruction: n, blk, frame_no, bx, by, place, mode, prediction, level, rec."""
    leaf = settled(_leaves(s, d).select("n", "blk", "place", "mode"), "leaves")  # read once for each size
    out = []
    for n in SIZES:
        own = _bordered(s, d, n).drop("place").join(leaf.where(F.col("n") == n).drop("n"), "blk")
        prediction = P.predicted_by(F.col("border"), F.col("mode"), n)
        own = own.withColumn("prediction", prediction).withColumn("r", F.zip_with("px", "prediction", lambda a, b: a - b))
        own = own.withColumn("level", T.quantize(T.dct(F.col("r"), n, n == 4), QP, n))
        own = own.withColumn("rec", T.reconstruct_or_predict(F.col("prediction"), F.col("level"), T.idct(T.dequantize(F.col("level"), QP, n), n, n == 4)))
        out.append(own.select("n", "blk", "frame_no", "tile", "bx", "by", "place", "mode", "prediction", "level", "rec"))
    return _union(out)


@_query
def leaf_reconstruction(s, d):
    """Each leaf predicted from the source around it, its residual coded and decoded."""
    px = lambda name: F.md5(F.array_join(name, ",")).alias(name)
    return _coded(s, d).select("n", "blk", "mode", px("prediction"), px("level"), T.sum_of_levels(F.col("level")).alias("levels"), px("rec"))


def _decoded(s: SparkSession, d: str) -> DataFrame:
    blocks = _coded(s, d).select("frame_no", (F.col("bx") * F.col("n")).alias("x"), (F.col("by") * F.col("n")).alias("y"), "n", F.col("rec").alias("px"))
    return RP.planes_of_blocks(blocks, "y", WIDTH, HEIGHT)


@_query
def decoded_psnr(s, d):
    """Decoded luma planes put together from leaves of all sizes, against the source."""
    found = R.plane_report(frames(s, d), _decoded(s, d).withColumns({"cb": F.lit(None).cast("binary"), "cr": F.lit(None).cast("binary")}))
    return found.select("frame_no", F.round("psnr_y", 6).alias("psnr_y"))


@_query
def planes_round_trip(s, d):
    """Planes cut into blocks and put together again."""
    def one(plane: str, n: int) -> DataFrame:
        scale = 1 if plane == "y" else 2
        w, h = WIDTH // scale, HEIGHT // scale
        blocks = RP.plane_blocks(frames(s, d), plane, w, h, n).select("frame_no", (F.col("bx") * n).alias("x"), (F.col("by") * n).alias("y"), F.lit(n).alias("n"), "px")
        return RP.planes_of_blocks(blocks, plane, w, h).select("frame_no", F.lit(plane).alias("plane"), F.length(plane).alias("n_bytes"), F.md5(plane).alias("digest"))

    return _union([one("y", 32), one("cb", 16), one("cr", 8)])


def _levels(s: SparkSession, d: str, qp: int = 22) -> DataFrame:
    """Levels of the residual blocks of all sizes, for brightness and up to 16 for colour, with a spread of modes: n, blk, luma, mode, level."""
    # vectors are dealt first, as their file is small for what becomes of it; levels are made once for brightness and colour
    vectors = B.dealt(_t(s, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    own = lambda n: B.residual_blocks(vectors, n).select(F.lit(n).alias("n"), "blk", (F.col("blk") * 7 % 35).cast("int").alias("mode"), T.quantize(T.dct(F.col("r"), n), qp, n).alias("level"))
    each = lambda n: own(n).select("n", "blk", F.explode(F.array(F.lit(True), *([F.lit(False)] if n < 32 else []))).alias("luma"), "mode", "level")
    return _union([each(n) for n in SIZES])


def _bins(s: SparkSession, d: str) -> DataFrame:
    return C.coefficient_bins(_levels(s, d), "n", "blk", "luma")


@_query
def coefficient_bins(s, d):
    """Bins of levels and the contexts of each, within their element."""
    return _bins(s, d).withColumn("ctx", F.array_join("ctx", ","))


@_query
def bin_contexts(s, d):
    """Each bin's context among all, and the state that it begins with."""
    return C.with_contexts(_bins(s, d), C.context_table(s), F.lit(22))


@_query
def packed_bins(s, d):
    """Bins of each size's blocks as streams of bytes, 256 to a row."""
    bins = settled(_bins(s, d).drop("ctx"), "bins")  # sums of their sizes and the bins themselves are read from it
    at = E.bit_offsets(bins, ["n", "luma"], "blk", [F.desc("grp"), F.col("ord")], "bins", bucket=64)
    return E.packed(at, ["n", "luma"], "bins", 256).select("n", "luma", "chunk", F.length("data").alias("n_bytes"), F.md5("data").alias("digest"))


def _around(leaf: DataFrame) -> DataFrame:
    """Leaves with size and mode of the leaf left and above of their first sample, null where there is none in the tile."""
    side = F.col("n") / 4
    cell = leaf.withColumns({"cx": (F.col("bx") * side).cast("int"), "cy": (F.col("by") * side).cast("int")})
    along = F.sequence(F.lit(0), (side - 1).cast("int"))
    at = lambda part, x, y: F.transform(along, lambda i: F.struct(x(i).cast("int").alias("cx"), y(i).cast("int").alias("cy"), F.lit(part).alias("part"), F.col("n").alias("size"), F.col("mode").alias("its")))
    told = cell.select("frame_no", "tile", F.inline(F.concat(at("left", lambda i: F.col("cx") + side, lambda i: F.col("cy") + i), at("top", lambda i: F.col("cx") + i, lambda i: F.col("cy") + side))))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{part}_{c}")
    place = ["frame_no", "tile", "cx", "cy"]
    return cell.join(told.groupBy(*place).agg(of("left", "size"), of("top", "size"), of("left", "its"), of("top", "its")), place, "left")


@_query
def tree_syntax(s, d):
    """Bins of the luma side of all trees in the order in which they are coded: splits, modes, flags and levels of a tile's leaves as one sequence."""
    coded = settled(_coded(s, d).select("n", "blk", "frame_no", "tile", "bx", "by", "place", "mode", "level"), "coded")
    leaf = _around(coded.drop("level"))
    none = F.lit(None).cast("array<int>")
    row = lambda place, step, part, element, b, c: F.struct(place.cast("long").alias("place"), F.lit(step).alias("step"), F.lit(0).alias("down"), part.cast("int").alias("part"), F.lit(element).alias("element"), b.alias("bins"), c.alias("ctx"))
    zero, place = F.lit(0), F.col("place")
    split = lambda size: F.array(((F.coalesce(F.col("left_size"), F.lit(99)) < size).cast("int") + (F.coalesce(F.col("top_size"), F.lit(99)) < size).cast("int")))
    flag = lambda c: c.cast("int").cast("string")
    top = F.when(F.col("cy") % (P.CTU // 4) != 0, F.col("top_its"))
    leaf = leaf.withColumn("cand", NB.probable_modes(F.col("left_its"), top)).withColumn("idx", NB.mode_index(F.col("mode"), F.col("cand")))
    first = place - F.when(F.col("n") == 4, place % 4).otherwise(0)  # of the four leaves of 4 that are coded together
    rows = F.array(
        row(place, 0, zero, "split", F.when(place % 64 == 0, flag(F.col("n") < 32)), split(32)),
        row(place, 1, zero, "split", F.when((place % 16 == 0) & (F.col("n") <= 16), flag(F.col("n") < 16)), split(16)),
        row(place, 2, zero, "part", F.when((place % 4 == 0) & (F.col("n") <= 8), flag(F.col("n") != 4)), F.array(zero)),
        row(first, 3, place % 4, "luma_mode", flag(F.col("idx") < 3), F.array(zero)),
        row(first, 4, place % 4, "luma_mode_rest", F.substring(E.mode_bins(F.col("idx")), 2, 9), none),
    )
    modes = leaf.select("frame_no", "tile", F.inline(rows)).where("bins is not null")
    cbf = coded.select("frame_no", "tile", "place", F.lit(5).alias("step"), zero.alias("down"), zero.alias("part"), F.lit("coded").alias("element"), flag(T.coded(F.col("level"))).alias("bins"), F.array(E.coded_flag_context(F.col("n"), F.lit(True))).alias("ctx"))
    bins = C.coefficient_bins(coded.withColumn("luma", F.lit(True)).select("frame_no", "tile", "place", "n", "mode", "luma", "level"), "frame_no", "tile", "place")
    levels = bins.select("frame_no", "tile", "place", F.lit(6).alias("step"), (1024 - F.col("grp")).alias("down"), F.col("ord").alias("part"), "element", "bins", "ctx")
    return _union([modes, cbf, levels]).withColumn("ctx", F.array_join("ctx", ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in clip_oracles.all_sql().items() if k in _QUERIES}
