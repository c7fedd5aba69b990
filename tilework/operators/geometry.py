"""Uniform tile grids, block addresses, scan orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_uniform(df: DataFrame, n: Column, k: Column) -> DataFrame:
    """A row per part j of n blocks in k parts: j, size, start (both by whole division, so parts differ by one at most)."""
    out = df.withColumns({"n": n, "k": k}).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return out.withColumns({"start": F.expr("j * n div k"), "size": F.expr("(j + 1) * n div k - j * n div k")})


def tile_bounds(tiles: DataFrame, block: int = 32) -> DataFrame:
    """First and last sample of tiles (start, size in blocks)."""
    return tiles.withColumns({"first_pel": F.col("start") * block, "last_pel": (F.col("start") + F.col("size")) * block - 1})


def largest_tile(tiles: DataFrame, *by: str) -> DataFrame:
    """by, most: the largest size of tiles (size), which a buffer for any of them must hold."""
    return tiles.groupBy(*by).agg(F.max("size").alias("most"))


def block_start(number: Column, width: Column, block: int = 32) -> tuple[Column, Column]:
    """x and y of the block with that number in a frame so many blocks wide."""
    return (number % width) * block, F.floor(number / width).cast("long") * block


def block_number(x: Column, y: Column, width: Column, block: int = 32) -> Column:
    return F.floor(y / block).cast("long") * width + F.floor(x / block).cast("long")


def blocks_in_tiles(tiles: DataFrame) -> DataFrame:
    """tiles (w, h, x0, y0 in blocks): a row per block in raster order within its tile, and whether it is the last."""
    out = tiles.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)))
    return out.withColumns({"bx": F.col("x0") + F.col("seq") % F.col("w"), "by": F.expr("y0 + seq div w"), "is_last": F.col("seq") == F.col("w") * F.col("h") - 1})


def scan_order(spark: SparkSession, sizes: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    """n, kind (diag, hor, ver), pos (order), y, x. Larger blocks are scanned by 4x4 groups, groups and samples in the same order."""
    out = None
    for n in sizes:
        at = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("y"), (F.col("id") % n).cast("int").alias("x"))
        gy, gx, iy, ix = F.expr("y div 4"), F.expr("x div 4"), F.col("y") % 4, F.col("x") % 4
        keys = {"diag": (gx + gy, gx, ix + iy, ix), "hor": (gy, gx, iy, ix), "ver": (gx, gy, ix, iy)}
        for kind, key in keys.items():
            # at most 1,024 places
            part = at.withColumn("key", F.struct(*[k.cast("int").alias(f"k{i}") for i, k in enumerate(key)]))
            whole = part.agg(F.array_sort(F.collect_list(F.struct("key", "y", "x"))).alias("a"))
            one = whole.select(F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.posexplode("a").alias("pos", "c")).select("n", "kind", "pos", "c.y", "c.x")
            out = one if out is None else out.unionAll(one)
    return out


def scan_kind(size: Column, mode: Column, luma: Column) -> Column:
    """Small blocks are scanned across the direction of their mode."""
    small = F.when(luma, size.isin(4, 8)).otherwise(size == 4)
    return F.when(small & (F.abs(mode - 26) < 5), "hor").when(small & (F.abs(mode - 10) < 5), "ver").otherwise("diag")
