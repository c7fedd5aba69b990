"""Neighbourhoods: availability, filling, smoothing, most probable modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import round_shift


def fill(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Missing values take the last one before them, leading ones the first that follows."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(before, after))


def smooth(px: Column, n: int) -> Column:
    """(a + 2b + c + 2) >> 2 over an array of n values; both ends stay."""
    return F.transform(px, lambda b, i: F.when((i == 0) | (i == n - 1), b).otherwise(round_shift(F.get(px, i - 1) + 2 * b + F.get(px, i + 1), 2)))


#: Offsets on a grid: left below, left, corner, top, top right.
OFFSETS = ((-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def neighbour_mask(df: DataFrame, key: str, width: int) -> DataFrame:
    """key is a number on a grid of that width; mask has a bit for each neighbour that is there, from left below to top right."""
    x, y = F.col(key) % width, F.floor(F.col(key) / width).cast("long")
    at = df.select(F.col(key), x.alias("x"), y.alias("y"))
    wanted = at.select(key, F.inline(F.array(*[F.struct((F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny"), F.lit(1 << i).alias("bit")) for i, (dx, dy) in enumerate(OFFSETS)])))
    there = at.select(F.col("x").alias("nx"), F.col("y").alias("ny"))
    found = wanted.join(there, ["nx", "ny"]).groupBy(key).agg(F.sum("bit").cast("int").alias("mask"))
    return at.join(found, key, "left").select(key, F.coalesce("mask", F.lit(0)).alias("mask"))


def uses_smoothing(size: Column, mode: Column) -> Column:
    """Whether references are smoothed: planar (0) from 8 on, directions far enough from straight ones."""
    far = F.least(F.abs(mode - 10), F.abs(mode - 26))
    limit = F.when(size == 8, 7).when(size == 16, 1).otherwise(0)
    return F.when((size == 4) | (mode == 1), False).otherwise((mode == 0) | (far > limit))


def probable_modes(left: Column, top: Column) -> Column:
    """Three candidates from the modes of the left and top neighbour (null: absent, taken as DC)."""
    a, b = F.coalesce(left, F.lit(1)), F.coalesce(top, F.lit(1))
    same = F.when(a < 2, F.array(F.lit(0), F.lit(1), F.lit(26))).otherwise(F.array(a, 2 + (a + 29) % 32, 2 + (a - 2 + 1) % 32))
    third = F.when((a != 0) & (b != 0), 0).when((a != 1) & (b != 1), 1).otherwise(26)
    return F.when(a == b, same).otherwise(F.array(a, b, third))


def mode_index(mode: Column, candidates: Column) -> Column:
    """0 to 2 for a candidate, else 3 and up among the remaining modes."""
    at = F.array_position(candidates, mode).cast("int")
    return F.when(at > 0, at - 1).otherwise(mode - F.size(F.filter(candidates, lambda c: c < mode)) + 3)
