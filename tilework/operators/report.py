"""Rate and distortion reports over a frame and tile hierarchy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import psnr
from .blocks import dealt


def tile_stats(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """gop, frame, tile, bytes: orders and their lines stand in for frames and tiles; quantities are summed to one row per tile first."""
    # dealt by frame before they are summed: lines hardly share a tile, so sums of a task that reads them would hold nearly each line
    tiles = dealt(lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("tile")).agg(F.sum("l_quantity").cast("long").alias("bytes"))
    return tiles.join(orders.select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("gop"), F.year("o_orderdate").alias("year")), "frame")


def bytes_rollup(tiles: DataFrame) -> DataFrame:
    """Sums of bytes per tile, frame, gop and in all (level 3 to 0)."""
    out = tiles.rollup("gop", "frame", "tile").agg(F.sum("bytes").alias("bytes"), (3 - F.expr("bit_count(grouping_id())")).cast("int").alias("level"))
    return out.select("level", "gop", "frame", "tile", "bytes")


def byte_rate(frames: DataFrame, fps: int, *by: str) -> DataFrame:
    """KiB per second: mean bytes of a frame times frames per second. frames: by, bytes."""
    return frames.groupBy(*by).agg(F.count("*").alias("frames"), F.round(F.avg("bytes") * fps / 1024, 6).alias("kib_per_s"))


def weighted_mean(y: Column, cb: Column, cr: Column) -> Column:
    """Mean of three planes' decibels, brightness four times."""
    return (4 * y + cb + cr) / 6


def wide(tiles: DataFrame, count: int) -> DataFrame:
    """One row per frame with a column per tile."""
    return tiles.groupBy("frame").agg(*[F.sum(F.when(F.col("tile") == i, F.col("bytes"))).alias(f"tile{i}_bytes") for i in range(1, count + 1)])


def plane_report(source: DataFrame, coded: DataFrame) -> DataFrame:
    """frame_no, psnr_y, psnr_cb, psnr_cr, psnr of frames (frame_no, y, cb, cr) and their coded version; null where planes are equal."""

    def samples(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].astype(np.int64), at - at[0]

    def squares(a: pa.Array, b: pa.Array) -> pa.Array:
        """Of whole batches at once; null where a plane is missing."""
        missing = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        a, b = (pc.if_else(pa.array(missing), pa.scalar(b"", pa.binary()), x) for x in (a, b))
        (x, at), (y, other) = samples(a), samples(b)
        if (at != other).any():
            raise ValueError("planes differ in size")
        total = np.zeros(len(x) + 1, np.int64)
        np.cumsum((x - y) ** 2, out=total[1:])
        return pa.array(np.diff(total[at]), mask=missing)

    names = ("y", "cb", "cr")
    both = source.join(coded.select("frame_no", *[F.col(n).alias(f"coded_{n}") for n in names]), "frame_no")
    sse = F.arrow_udf(squares, "long")
    out = both.select("frame_no", *[psnr(sse(F.col(n), F.col(f"coded_{n}")), F.length(n)).alias(f"psnr_{n}") for n in names])
    return out.withColumn("psnr", weighted_mean(F.col("psnr_y"), F.col("psnr_cb"), F.col("psnr_cr")))
