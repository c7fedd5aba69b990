"""Square blocks of samples as array columns, and as rows.

Tables of vectors stand in for video: a vector of 64 numbers is an 8x8 block in raster order,
value v giving the residual floor(256 v) within -255..255 and the sample floor(256 v) + 128
within 0..255. Blocks of 16 and 32 are made of 4 and 16 consecutive vectors in Z order
(what the last one lacks is 128, or 0 in residuals), blocks of 4 are quarters of a vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, morton_x, morton_y


def residuals(v: Column) -> Column:
    return F.transform(v, lambda x: clip(-255, 255, F.floor(x * 256)).cast("int"))


def samples(v: Column) -> Column:
    return F.transform(v, lambda x: clip(0, 255, F.floor(x * 256) + 128).cast("int"))


def sample_blocks(vectors: DataFrame) -> DataFrame:
    """vec_id, label, px."""
    return vectors.select("vec_id", "label", samples(F.col("embedding")).alias("px"))


def grid_blocks(vectors: DataFrame, n: int, width: int = 10) -> DataFrame:
    """blk, bx, by, label, px: blocks of n x n samples on a picture ``width`` blocks of 8 wide (larger blocks make up a picture of as many of their own). The label is that of the first vector."""
    many = max(1, n // 8) ** 2
    px = _squares(vectors.select("vec_id", samples(F.col("embedding")).alias("r")), n, 128).withColumnRenamed("r", "px")
    first = F.expr("blk div 4") if n == 4 else F.col("blk") * many
    blk, q = F.col("blk"), F.col("blk") % 4
    bx, by = (F.expr("blk div 4") % width * 2 + q % 2, F.expr(f"blk div {4 * width} * 2 + blk % 4 div 2")) if n == 4 else (blk % width, F.expr(f"blk div {width}"))
    return px.withColumn("vec_id", first).join(vectors.select("vec_id", "label"), "vec_id").select("blk", bx.alias("bx"), by.alias("by"), "label", "px")


def residual_blocks(vectors: DataFrame, n: int) -> DataFrame:
    """blk, r: residual blocks of n x n samples in raster order."""
    return _squares(vectors.select("vec_id", residuals(F.col("embedding")).alias("r")), n, 0)


def _squares(base: DataFrame, n: int, fill: int) -> DataFrame:
    """base (vec_id, r: 64 values) as blocks of n x n: blk, r; missing vectors count as filled."""
    if n == 8:
        return base.select(F.col("vec_id").alias("blk"), "r")
    if n == 4:
        quarter = lambda q: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(F.col("r"), (F.floor(i / 4) + 4 * (q // 2)).cast("int") * 8 + i % 4 + 4 * (q % 2)))
        return base.select(F.col("vec_id"), F.posexplode(F.array(*[quarter(q) for q in range(4)])).alias("q", "r")).select((F.col("vec_id") * 4 + F.col("q")).alias("blk"), "r")
    side = n // 8
    many = side * side
    parts = base.groupBy(F.expr(f"vec_id div {many}").alias("blk")).agg(F.collect_list(F.struct((F.col("vec_id") % many).cast("int").alias("q"), "r")).alias("parts"))
    held = parts.select("blk", F.map_from_entries("parts").alias("held"))
    ordered = held.select("blk", F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda q: F.coalesce(F.try_element_at("held", q), F.array_repeat(F.lit(fill), 64))).alias("parts"))
    # the part that holds a row's and column's sample, in Z order
    z = {(0, 0): 0}
    for q in range(many):
        x = y = 0
        for b in range(3):
            x |= (q >> 2 * b & 1) << b
            y |= (q >> 2 * b + 1 & 1) << b
        z[y, x] = q
    rows = [F.concat(*[F.slice(F.get(F.col("parts"), F.lit(z[y // 8, x])), y % 8 * 8 + 1, 8) for x in range(side)]) for y in range(n)]
    return ordered.select("blk", F.concat(*rows).alias("r"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by columns to as many partitions as the session shuffles to, so that what they grow into, or a grouping by these columns, doesn't meet in the few tasks that read a small file."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def cells(blocks: DataFrame, column: str, n: int, *keep: str) -> DataFrame:
    """A row per sample: y, x, and its value under the column's name."""
    return blocks.select(*keep, F.posexplode(column).alias("p", column)).select(*keep, F.expr(f"p div {n}").cast("int").alias("y"), (F.col("p") % n).alias("x"), column)


def pairs(blocks: DataFrame) -> DataFrame:
    """Each block with the next one: vec_id, px, nxt."""
    after = blocks.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("nxt"))
    return blocks.join(after, "vec_id")


def sad(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def sse(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def zorder(z: Column) -> tuple[Column, Column]:
    return morton_x(z), morton_y(z)
