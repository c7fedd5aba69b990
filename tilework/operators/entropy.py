"""Statistics and codes of coefficient blocks, context states, emulation prevention, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bit_length, bits_to_hex, clip, exp_golomb, fixed_bits, signed_exp_golomb


def last_significant(levels: DataFrame, scan: DataFrame, n: int, kind: str = "diag") -> DataFrame:
    """levels (blk, level): number of levels that aren't 0, and the scan position, y and x of the last one; blocks without any are left out."""
    order = scan.where((F.col("n") == n) & (F.col("kind") == kind)).select("pos", (F.col("y") * n + F.col("x")).alias("p"))
    at = levels.select("blk", F.posexplode("level").alias("p", "v")).where("v != 0").join(F.broadcast(order), "p")
    return at.groupBy("blk").agg(F.count("*").alias("n_sig"), F.max("pos").alias("last_pos"), F.max_by("p", "pos").alias("p")).select("blk", "n_sig", "last_pos", F.expr(f"p div {n}").alias("y"), (F.col("p") % n).alias("x"))


def group_flags(levels: DataFrame, n: int) -> DataFrame:
    """blk, gy, gx of 4x4 groups with a level that isn't 0, and ctx: whether the right (1) or lower (2) group has one."""
    flags = levels.select("blk", F.posexplode("level").alias("p", "v")).where("v != 0").select("blk", F.expr(f"p div {4 * n}").alias("gy"), F.expr(f"p % {n} div 4").alias("gx")).distinct()
    near = flags.select("blk", F.inline(F.array(F.struct("gy", (F.col("gx") - 1).alias("gx"), F.lit(1).alias("bit")), F.struct((F.col("gy") - 1).alias("gy"), F.col("gx").alias("gx"), F.lit(2).alias("bit")))))
    seen = near.groupBy("blk", "gy", "gx").agg(F.sum("bit").alias("ctx"))
    return flags.join(seen, ["blk", "gy", "gx"], "left").select("blk", "gy", "gx", F.coalesce("ctx", F.lit(0)).alias("ctx"))


#: Fixed values of the public H.265 specification: contexts of the places of a 4x4 block, in raster order.
PLACES_4X4 = (0, 1, 4, 5, 2, 3, 4, 5, 6, 6, 8, 8, 7, 7, 8, 8)


def significance_context(pattern: Column, kind: Column, x: Column, y: Column, size: Column, luma: Column) -> Column:
    """Context of the flag that says whether the level at x, y isn't 0. pattern: as ctx of group_flags; kind: of the scan."""
    u, v = x % 4, y % 4
    near = lambda a: F.when(a == 0, 2).when(a == 1, 1).otherwise(0)
    sum_ = u + v
    count = F.when(pattern == 0, F.when(sum_ == 0, 2).when(sum_ <= 2, 1).otherwise(0)).when(pattern == 1, near(v)).when(pattern == 2, near(u)).otherwise(2)
    base = F.when(size == 8, F.when(kind == "diag", 9).otherwise(15)).when(luma, 21).otherwise(12)
    later = F.when(luma & ((x >= 4) | (y >= 4)), 3).otherwise(0)
    small = F.element_at(F.array(*map(F.lit, PLACES_4X4)), (F.least(y, F.lit(3)) * 4 + F.least(x, F.lit(3)) + 1).cast("int"))
    return F.when((x == 0) & (y == 0), 0).when(size == 4, small).otherwise(base + count + later)


def coded_flag_context(size: Column, luma: Column) -> Column:
    """Context of the flag of a transform block with levels."""
    return F.when(luma & (size != 4), 1).otherwise(0)


def context_state(value: Column, qp: Column) -> Column:
    """State of a context from its initial value: twice the distance from the middle, plus the likelier bin."""
    slope, offset = F.shiftright(value, 4) * 5 - 45, F.shiftleft(value.bitwiseAND(15), 3) - 16
    state = clip(1, 126, F.shiftright(slope * qp, 4) + offset)
    return F.when(state > 63, (state - 64) * 2 + 1).otherwise((63 - state) * 2)


def mode_bins(index: Column) -> Column:
    """Bins of a luma mode: a flag, then a short code for a candidate or five bits."""
    return F.when(index < 3, F.concat(F.lit("1"), F.element_at(F.array(F.lit("0"), F.lit("10"), F.lit("11")), F.least(index, F.lit(2)) + 1))).otherwise(F.concat(F.lit("0"), fixed_bits(F.greatest(index - 3, F.lit(0)), 5)))


def chroma_mode_bins(index: Column) -> Column:
    """Bins of a chroma mode: a single 0 for the luma mode (4), else 1 and two bits."""
    return F.when(index == 4, "0").otherwise(F.concat(F.lit("1"), fixed_bits(F.least(index, F.lit(3)), 2)))


def last_position_bins(v: Column, n: int) -> Column:
    """Prefix (a unary group number, cut off at the last group) and suffix of a coordinate of the last level."""
    group = F.when(v < 4, v).otherwise(2 * (bit_length(v) - 1) + F.call_function("shiftright", v, bit_length(v) - 2) % 2)
    top = 2 * n.bit_length() - 3
    extra = F.expr("0") if n < 8 else F.greatest(F.call_function("shiftright", group - 2, F.lit(1)), F.lit(0))
    prefix = F.concat(F.repeat(F.lit("1"), group), F.when(group < top, "0").otherwise(""))
    low = F.call_function("shiftleft", F.lit(2) + group % 2, extra)
    return F.concat(prefix, F.when(group > 3, F.lpad(F.bin(v - low), extra, F.lit("0"))).otherwise(""))


def emulation_inserts(stream: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, n_bytes, inserts: how many marks keep runs of zero bytes from looking like a start code.

    A run of n zeros takes (n - 1) div 2 marks, one more where n is even and the next byte is 1, 2 or 3,
    or where the stream ends with it. No loop over bytes: runs are islands between other bytes.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    marked = stream.withColumn("run", F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nxt", F.lead(value).over(w))
    runs = marked.groupBy(*by, "run").agg(F.count_if(F.col(value) == 0).alias("zeros"), F.max(F.when((F.col(value) == 0) & ((F.col("nxt") != 0) | F.col("nxt").isNull()), F.coalesce("nxt", F.lit(-1)))).alias("nxt"), F.count("*").alias("n"))
    extra = F.when((F.col("zeros") % 2 == 0) & (F.col("zeros") > 0) & F.col("nxt").isin(1, 2, 3), 1).otherwise(0)
    ends = F.when((F.col("nxt") == -1) & (F.col("zeros") > 0), 1).otherwise(0)
    inserts = F.when(F.col("zeros") > 0, F.expr("(zeros - 1) div 2")).otherwise(0) + extra
    return runs.groupBy(*by).agg(F.sum("n").alias("n_bytes"), F.sum(inserts).alias("inserts"), F.max(ends).alias("end_mark"))


def entry_points(sizes: DataFrame, frame: str, tile: str, size: str) -> DataFrame:
    """frame, n_tiles, width (bits of the largest size, less one), code: sizes of all tiles but the last, in order."""
    w = Window.partitionBy(frame)
    rows = sizes.withColumn("is_last", F.col(tile) == F.max(tile).over(w)).withColumn("most", F.max(size).over(w)).withColumn("bits", F.greatest(bit_length(F.col("most") - 1), F.lit(1)))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_last"), F.struct(F.col(tile).alias("t"), fixed_bits(F.col(size) - 1, F.col("bits")).alias("c"))))), lambda x: x["c"]), "")
    return rows.groupBy(frame).agg(F.count("*").alias("n_tiles"), F.max("bits").alias("width"), code.alias("code"))


def header(fields: DataFrame, by: str) -> DataFrame:
    """fields (by, ord, kind u|ue|se, value, bits): the header's bits, closed with a 1 and zeros to a whole byte."""
    code = F.when(F.col("kind") == "u", F.lpad(F.bin("value"), F.col("bits"), F.lit("0"))).when(F.col("kind") == "ue", exp_golomb(F.greatest(F.col("value"), F.lit(0)))).otherwise(signed_exp_golomb(F.col("value")))
    whole = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", code.alias("c")))), lambda x: x["c"]), ""), F.lit("1"))
    return fields.groupBy(by).agg(whole.alias("b")).select(by, F.rpad("b", F.expr("(length(b) + 7) div 8 * 8"), F.lit("0")).alias("bits"))


def bit_offsets(rows: DataFrame, by: list[str], segment: str, order: list[Column], bits: str, bucket: int = 4096) -> DataFrame:
    """rows with first_bit: where each row's bits begin in its stream (by), rows being ordered by segment (a whole number) and order.

    Sums run on three levels: over the rows of a segment, over the segments of a bucket, and over buckets, so
    that no task sees more of a stream than a segment's rows, a bucket's segments or all buckets' sums.
    """
    size = F.length(bits).cast("long")
    inside = Window.partitionBy(*by, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__at", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    sums = rows.groupBy(*by, segment).agg(F.sum(size).alias("__size")).withColumn("__bucket", F.floor(F.col(segment) / bucket))
    within = Window.partitionBy(*by, "__bucket").orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.groupBy(*by, "__bucket").agg(F.sum("__size").alias("__size")).withColumn("__first", F.coalesce(F.sum("__size").over(over), F.lit(0))).drop("__size")
    starts = sums.withColumn("__start", F.coalesce(F.sum("__size").over(within), F.lit(0))).join(buckets, [*by, "__bucket"]).select(*by, segment, (F.col("__start") + F.col("__first")).alias("__start"))
    return own.join(starts, [*by, segment]).withColumn("first_bit", F.col("__at") + F.col("__start")).drop("__at", "__start")


def packed(rows: DataFrame, by: list[str], bits: str, chunk: int = 1024) -> DataFrame:
    """by, chunk (number), data (binary): the bits of rows (with first_bit) as bytes, so many to a row but for the last of a stream, which ends in zero bits. A row's bits may lie in several chunks."""
    end = F.col("first_bit") + F.length(bits)
    numbers = F.sequence(F.floor(F.col("first_bit") / (8 * chunk)), F.floor((end - 1) / (8 * chunk)))
    parts = rows.where(F.length(bits) > 0).select(*by, "first_bit", F.col(bits).alias("__bits"), F.explode(numbers).alias("chunk"))
    low = F.greatest(F.col("first_bit"), F.col("chunk") * 8 * chunk)
    high = F.least(F.col("first_bit") + F.length("__bits"), (F.col("chunk") + 1) * 8 * chunk)
    parts = parts.select(*by, "chunk", F.struct(low.alias("at"), F.substring("__bits", (low - F.col("first_bit") + 1).cast("int"), (high - low).cast("int")).alias("b")).alias("p"))
    whole = parts.groupBy(*by, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "").alias("b"))
    whole = whole.withColumn("b", F.rpad("b", F.expr("(length(b) + 7) div 8 * 8").cast("int"), F.lit("0")))
    return whole.select(*by, "chunk", F.unhex(bits_to_hex(F.col("b"))).alias("data"))
