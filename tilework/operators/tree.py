"""Tiles, coding order and trees of blocks of different sizes.

Blocks of a frame are coded tile by tile, in a tile tree block by tree block (32x32, in raster
order), and inside a tree block in Z order. A tree's leaves are blocks of 4 to 32; a leaf of n
has colour blocks of n / 2, but four leaves of 4 share one of 4.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CTU = 32


def interval_of(points: DataFrame, intervals: DataFrame, at: str, by: Sequence[str] = (), bucket: int = 8, first: str = "start", size: str = "size") -> DataFrame:
    """points with the columns of the interval that holds them: first <= at < first + size, with by in common.

    An interval is known by each bucket of so many places that it touches, a point by its own, so
    this is an equal join whose work grows with points and with buckets touched, not with their product, and points aren't copied.
    Points in no interval are left out. Choose buckets about as large as intervals.
    """
    low, high = F.floor(F.col(first) / bucket), F.floor((F.col(first) + F.col(size) - 1) / bucket)
    known = intervals.where(F.col(size) > 0).withColumn("__bucket", F.explode(F.sequence(low, high)))
    met = points.withColumn("__bucket", F.floor(F.col(at) / bucket)).join(known, [*by, "__bucket"])
    return met.where((F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + F.col(size))).drop("__bucket")


def z_order(x: Column, y: Column, bits: int = 3) -> Column:
    """Place in Z order of column x and row y."""
    out = F.lit(0)
    for i in range(bits):
        out = out + F.shiftleft(F.shiftright(x.cast("int"), i).bitwiseAND(1), 2 * i) + F.shiftleft(F.shiftright(y.cast("int"), i).bitwiseAND(1), 2 * i + 1)
    return out


def coding_order(blocks: DataFrame, n: int, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """blocks (bx, by in blocks of n) with tile (number in raster order) and place (of the first 4x4 in its tile's coding order).

    columns and rows: the tile grid (j, k, start, size in tree blocks), as split_uniform() gives it.
    """
    per = CTU // n
    cx, cy = F.expr(f"bx div {per}"), F.expr(f"by div {per}")
    axis = lambda df, name: df.select(F.col("j").alias(f"__{name}_j"), F.col("start").alias(f"__{name}"), F.col("size").alias(f"__{name}_size"), F.col("k").alias(f"__{name}_k"))
    at = interval_of(blocks.withColumns({"__cx": cx, "__cy": cy}), axis(columns, "x"), "__cx", first="__x", size="__x_size")
    at = interval_of(at, axis(rows, "y"), "__cy", first="__y", size="__y_size")
    z = z_order(F.col("bx") % per, F.col("by") % per) * (n // 4) ** 2
    place = ((F.col("__cy") - F.col("__y")) * F.col("__x_size") + F.col("__cx") - F.col("__x")) * (CTU // 4) ** 2 + z
    out = at.withColumns({"tile": (F.col("__y_j") * F.col("__x_k") + F.col("__x_j")).cast("int"), "place": place.cast("long")})
    return out.select(*blocks.columns, "tile", "place")


def colour_areas(leaf: DataFrame) -> DataFrame:
    """n, node, luma_leaves, luma_mode of the colour blocks of leaves (level, node, mode): four of 4 share one of 4, of which the first one's mode counts."""
    small = F.col("level") == 0
    area = leaf.select(F.when(small, 1).otherwise(F.col("level")).alias("level"), F.when(small, F.expr("node div 4")).otherwise(F.col("node")).alias("area"), F.struct("node", "mode").alias("own"))
    first = area.groupBy("level", "area").agg(F.min("own").alias("own"), F.count("*").alias("luma_leaves"))
    return first.select(F.call_function("shiftleft", F.lit(2), F.col("level")).alias("n"), F.col("area").alias("node"), "luma_leaves", F.col("own.mode").alias("luma_mode"))
