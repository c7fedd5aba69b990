"""Intra prediction of square blocks from the samples around them, and the choice of a mode.

Blocks (n, blk, bx, by, label, px) lie on a grid. The border of a block of n x n has 4n + 1
samples, from the lowest left one up to the corner (place 2n) and on to the right end. Where a
neighbour isn't there, its part repeats the sample before it, a leading part the first sample
that is there, and without any neighbour all are 128. A direction reads the border at fixed
places, so all modes of a batch of blocks are one gather. Luma smooths the border by size and
mode, and the edges of some modes; colour planes (``chroma``) do neither.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import probable_modes

MODES = 35
CTU = 32
#: Displacement per row of the modes 2 to 34, in 1/32 samples.
ANGLES = (32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32)


@lru_cache
def places(mode: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a direction: both border places that each sample mixes, and the weight of the second."""
    angle, sign, corner = ANGLES[mode - 2], 1 if mode >= 18 else -1, 2 * n
    inverse = round(8192 / angle) if angle else 0

    def at(k: int) -> int:
        return corner + sign * k if k >= 0 else corner - sign * ((k * inverse + 128) >> 8)

    one, two, f = (np.zeros((n, n), np.int64) for _ in range(3))
    for y in range(n):
        for x in range(n):
            i, j = (y, x) if sign > 0 else (x, y)
            k, f[y, x] = j + ((i + 1) * angle >> 5) + 1, (i + 1) * angle & 31
            one[y, x], two[y, x] = at(k), at(k + 1) if f[y, x] else at(k)
    return one, two, f


def smoothed(border: np.ndarray) -> np.ndarray:
    out = border.copy()
    out[:, 1:-1] = (border[:, :-2] + 2 * border[:, 1:-1] + border[:, 2:] + 2) >> 2
    return out


def smooths(mode: int, n: int) -> bool:
    """Whether luma of that size reads the smoothed border; as neighbours.uses_smoothing."""
    far = min(abs(mode - 10), abs(mode - 26)) > {8: 7, 16: 1, 32: 0}.get(n, 99)
    return n > 4 and mode != 1 and (mode == 0 or far)


def predict(border: np.ndarray, mode: int, n: int, chroma: bool = False) -> np.ndarray:
    """(b, 4n + 1) borders to (b, n, n) predictions."""
    if not chroma and smooths(mode, n):
        border = smoothed(border)
    c, log = 2 * n, n.bit_length() - 1
    left, top, corner = border[:, c - 1 : c - 1 - n : -1], border[:, c + 1 : c + 1 + n], border[:, c]
    if mode == 0:
        i = np.arange(n)
        across = (n - 1 - i)[None, None, :] * left[:, :, None] + (i + 1)[None, None, :] * border[:, c + 1 + n][:, None, None]
        down = (n - 1 - i)[None, :, None] * top[:, None, :] + (i + 1)[None, :, None] * border[:, c - 1 - n][:, None, None]
        return (across + down + n) >> log + 1
    if mode == 1:
        dc = (left.sum(1) + top.sum(1) + n) >> log + 1
        out = np.repeat(dc, n * n).reshape(-1, n, n)
        if not chroma:
            out[:, 0, :], out[:, :, 0] = (top + 3 * dc[:, None] + 2) >> 2, (left + 3 * dc[:, None] + 2) >> 2
            out[:, 0, 0] = (left[:, 0] + 2 * dc + top[:, 0] + 2) >> 2
        return out
    one, two, f = places(mode, n)
    out = ((32 - f) * border[:, one] + f * border[:, two] + 16) >> 5
    if mode == 26 and not chroma:
        out[:, :, 0] = np.clip(top[:, :1] + ((left - corner[:, None]) >> 1), 0, 255)
    elif mode == 10 and not chroma:
        out[:, 0, :] = np.clip(left[:, :1] + ((top - corner[:, None]) >> 1), 0, 255)
    return out


#: Blocks of 16 x 16 places are an area.
AREA = 4
#: Which parts of a border a block gives to others: name, offset of the receiver.
GIVEN = (("left_low", 1, -1), ("left", 1, 0), ("corner", 1, 1), ("top", 0, 1), ("top_right", -1, 1))


def borders(blocks: DataFrame, n: int, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Each block with its border, and the labels of the blocks left and above (null where there are none; above also at the top of a tree block).

    by: columns that neighbours have in common, such as frame and tile. order: a column with the place
    in coding order; blocks that come later count as not there. Two blocks at one place are an error.
    Blocks send the few samples that their neighbours need, and whole blocks are moved once, dealt by areas of the picture: what is sent within
    an area is cut from its blocks after they have moved, and only what leaves an area is moved itself. All then meet in one grouping by place.
    With either, mask has a bit for each neighbour that counts, from left below to top right.
    """
    def edges(px: Column) -> dict[str, Column]:
        right = F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda y: F.get(px, y * n + n - 1))
        low = F.slice(px, n * n - n + 1, n)
        return {"left_low": right, "left": right, "corner": F.slice(px, n * n, 1), "top": low, "top_right": low}

    def field(part: str, x: Column, y: Column, blk: Column, key: Column, label: Column, s: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), x.alias("x"), y.alias("y"), blk.alias("blk"), F.struct(key.alias("key"), label.alias("label"), s.alias("s")).alias("v"))

    area = lambda c: F.shiftright(c, AREA)

    def sent(x: Column, y: Column, key: Column, label: Column, px: Column, when: Callable[[Column], Column]) -> list[Column]:
        """What a block gives to others, null where when (of whether the place is in the block's own area) isn't true."""
        stays = lambda dx, dy: area(x + dx).eqNullSafe(area(x)) & area(y + dy).eqNullSafe(area(y))
        return [F.when(when(stays(dx, dy)), field(name, x + dx, y + dy, F.lit(None).cast("long"), key, label, edges(px)[name])) for name, dx, dy in GIVEN]

    x, y, blk = (F.col(c).cast("long") for c in ("bx", "by", "blk"))
    own = F.col(order).cast("long") if order else F.lit(0).cast("long"), F.col("label").cast("int"), F.col("px")
    moved = blocks.select(*by, F.inline(F.array(field("own", x, y, blk, *own), *sent(x, y, *own, when=lambda stays: ~stays)))).where("part is not null")
    moved = moved.withColumns({"__area_x": area(F.col("x")), "__area_y": area(F.col("y"))}).repartition(*by, "__area_x", "__area_y")
    inside = sent(*(F.col(c) for c in ("x", "y", "v.key", "v.label", "v.s")), when=lambda stays: stays & (F.col("part") == "own"))
    place = [*by, "__area_x", "__area_y", "x", "y"]
    rows = moved.select(*place[:-2], F.inline(F.array(F.struct("part", "x", "y", "blk", "v"), *inside))).where("part is not null")
    of = lambda part, c="v": F.max(F.when(F.col("part") == part, F.col(c)))
    met = rows.groupBy(*place).agg(of("own", "blk").alias("blk"), F.count_if(F.col("part") == "own").alias("here"), of("own").alias("own"), *[of(name).alias(name) for name, *_ in GIVEN])
    met = met.where(F.col("here") > 0).withColumn("blk", F.when(F.col("here") == 1, F.col("blk")).otherwise(F.raise_error(F.lit("two blocks lie at one place")).cast("long")))
    if order:
        met = met.withColumns({name: F.when(F.col(f"{name}.key") < F.col("own.key"), F.col(name)) for name, *_ in GIVEN})
    bits = [F.when(F.col(name).isNotNull(), 1 << i).otherwise(0) for i, (name, *_) in enumerate(GIVEN)]
    met = met.select(*by, "x", "y", "blk", F.col("own.label").alias("label"), F.col("own.s").alias("px"), F.col("left.label").alias("left_mode"), F.col("top.label").alias("above"), sum(bits[1:], bits[0]).alias("mask"), *[F.col(f"{name}.s").alias(name) for name, *_ in GIVEN])
    start = F.coalesce(*[F.get(name, F.lit(0)) for name, *_ in GIVEN], F.lit(128))
    parts: list[Column] = []
    for name, *_ in GIVEN:
        before = F.element_at(parts[-1], -1) if parts else start
        met = met.withColumn(name, F.coalesce(F.col(name), F.array_repeat(before, 1 if name == "corner" else n)))
        parts.append(F.col(name))
    top_mode = F.when(F.col("y") * n % CTU != 0, F.col("above"))
    more = [F.col("x").alias("bx"), F.col("y").alias("by"), F.col("mask")] if by or order else []
    return met.select(*by, F.lit(n).alias("n"), "blk", "label", "px", "left_mode", top_mode.alias("top_mode"), F.concat(*parts).alias("border"), *more)


def _rows(arrays: pa.Array, n: int) -> np.ndarray:
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)


#: Numbers that are worked on at once, so that a worker's memory doesn't follow the rows of a batch.
LOT = 1 << 18


def _lots(many: int, each: int) -> list[slice]:
    step = max(1, LOT // each)
    return [slice(i, i + step) for i in range(0, many, step)]


def predicted(blocks: DataFrame, modes: Sequence[int], n: int, chroma: bool = False) -> DataFrame:
    """A row per block (with border) and mode, in their order: mode, and px, the prediction of n * n. Modes are dealt to rows before blocks go to Python, so no row holds more than one prediction."""
    each = blocks.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return each.withColumn("px", predicted_by(F.col("border"), F.col("mode"), n, chroma))


def predicted_by(border: Column, mode: Column, n: int, chroma: bool = False) -> Column:
    """Prediction of each block by its own mode, an array of n * n."""

    def run(b: pa.Array, m: pa.Array) -> pa.Array:
        b, m = _rows(b, 4 * n + 1), m.to_numpy(zero_copy_only=False)
        y = np.empty((len(m), n * n), np.int32)
        for one in np.unique(m):
            at = np.flatnonzero(m == one)
            for lot in _lots(len(at), n * n):
                y[at[lot]] = predict(b[at[lot]], int(one), n, chroma).reshape(-1, n * n)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, n * n), pa.int32()), pa.array(y.reshape(-1)))

    return F.arrow_udf(run, "array<int>")(border, mode)


def mode_sads(border: Column, px: Column, n: int, chroma: bool = False) -> Column:
    """Sum of absolute differences under each of the 35 modes."""

    def run(b: pa.Array, p: pa.Array) -> pa.Array:
        b, p = _rows(b, 4 * n + 1), p.flatten().to_numpy(zero_copy_only=False).reshape(-1, n * n)
        y = np.empty((len(b), MODES), np.int32)
        for lot in _lots(len(b), n * n):
            for m in range(MODES):
                y[lot, m] = np.abs(predict(b[lot], m, n, chroma).reshape(-1, n * n) - p[lot]).sum(1)
        y = y.reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) + 1, MODES), pa.int32()), pa.array(y))

    return F.arrow_udf(run, "array<int>")(border, px)


def _biased(sads: Column, cand: Column, qp: int) -> Column:
    bias = lambda m: F.when(m == F.get(cand, F.lit(0)), 1).when(F.array_contains(cand, m), 2).otherwise(3)
    return F.array_min(F.transform(sads, lambda s, m: F.struct((s + qp * bias(m)).alias("cost"), m.alias("mode"))))


def decide(blocks: DataFrame, n: int, qp: int = 32) -> DataFrame:
    """n, blk, mode, cost: the cheapest mode, on equal cost the lowest. Labels are the neighbours' modes; modes that are likely from them cost less."""
    b = borders(blocks, n).withColumn("cand", probable_modes(F.col("left_mode"), F.col("top_mode"))).withColumn("sads", mode_sads(F.col("border"), F.col("px"), n))
    best = _biased(F.col("sads"), F.col("cand"), qp)
    return b.select("n", "blk", best["mode"].alias("mode"), best["cost"].alias("cost"))


def decide_in_order(bordered: DataFrame, n: int, by: Sequence[str], order: str, qp: int = 32, rounds: int = 4) -> DataFrame:
    """by, blk, bx, by, order, mode, cost: modes whose costs are biased by the modes that were decided for the blocks left and above.

    bordered: of borders(), with order. The first round knows no modes (all are equally likely), each further one those of the round before. A
    block's neighbours come before it in coding order, so after as many rounds as blocks follow each other in a tree block's row
    the modes are those of deciding block after block; they stay as soon as a round changes none. Blocks are compared with
    all modes once; what meets the neighbours in each round is their modes alone.
    """
    place = [*by, "bx", "by"]
    own = ["blk", order, "mask", "sads"]
    now = bordered.withColumn("sads", mode_sads(F.col("border"), F.col("px"), n)).select(*place, *own)
    now = now.withColumn("best", F.array_min(F.transform("sads", lambda s, m: F.struct((s + 3 * qp).alias("cost"), m.alias("mode")))))
    for _ in range(rounds):
        # a block and what it tells those right and below meet in one grouping by place
        none = F.lit(None).cast(now.select(F.struct(*own)).schema[0].dataType)
        say = lambda part, dx, dy, mine: F.struct((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by"), F.lit(part).alias("part"), F.col("best.mode").alias("mode"), mine.alias("mine"))
        sent = now.select(*by, F.inline(F.array(say("own", 0, 0, F.struct(*own)), say("left", 1, 0, none), say("top", 0, 1, none))))
        of = lambda part: F.max(F.when(F.col("part") == part, F.col("mode"))).alias(part)
        met = sent.groupBy(*place).agg(F.max("mine").alias("mine"), of("left"), of("top")).where("mine is not null").select(*place, "mine.*", "left", "top")
        left = F.when(F.col("mask").bitwiseAND(2) != 0, F.col("left"))
        top = F.when((F.col("mask").bitwiseAND(8) != 0) & (F.col("by") * n % CTU != 0), F.col("top"))
        now = met.withColumn("cand", probable_modes(left, top)).withColumn("best", _biased(F.col("sads"), F.col("cand"), qp)).drop("left", "top", "cand")
    return now.select(*by, F.lit(n).alias("n"), "blk", "bx", "by", order, F.col("best.mode").alias("mode"), F.col("best.cost").cast("long").alias("cost"))


def decide_chroma(one: DataFrame, two: DataFrame, luma: DataFrame, n: int) -> DataFrame:
    """The best of five modes for two colour planes at once, given the luma mode (luma: blk, mode)."""
    sads = lambda plane, name: borders(plane, n).select("blk", mode_sads(F.col("border"), F.col("px"), n, chroma=True).alias(name))
    both = sads(one, "a").join(sads(two, "b"), "blk").join(luma.select("blk", F.col("mode").alias("luma")), "blk")
    fixed = F.transform(F.array(*map(F.lit, (0, 26, 10, 1))), lambda m: F.when(m == F.col("luma"), 34).otherwise(m))
    cost = F.transform(F.concat(fixed, F.array("luma")), lambda m, i: F.struct((F.get("a", m) + F.get("b", m)).alias("cost"), i.alias("i"), m.alias("mode")))
    best = F.array_min(cost)
    return both.select(F.lit(n).alias("n"), "blk", best["mode"].alias("mode"), best["cost"].alias("cost"))


def quadtree(own: DataFrame, levels: int, *keep: str) -> DataFrame:
    """own (level, node, cost, keep): costs of blocks, level 0 the finest, four nodes of a level to one of the next.

    A row per node with the best cost (best), whether it is split: where its parts' best costs add up to
    less than its own, and whether it is a leaf: not split, and all above it are. Nodes without four parts aren't split. A tree's
    nodes (at most 85 of four levels) meet in one grouping and are folded there, level by level.
    """
    root = F.expr(f"node div cast(pow(4, {levels - 1} - level) as bigint)")
    tree = own.select(root.alias("__root"), F.struct(F.col("level").cast("int").alias("level"), F.col("node").cast("long").alias("node"), F.col("cost").cast("long").alias("cost"), *keep).alias("x")).groupBy("__root").agg(F.collect_list("x").alias("nodes"))
    done = []
    for level in range(levels):
        parts = " + ".join(f"try_element_at(best{level - 1}, 4 * x.node + {i})" for i in range(4)) if level else "cast(null as bigint)"
        tree = tree.withColumn(f"sums{level}", F.expr(f"transform(filter(nodes, x -> x.level = {level}), x -> struct(x, {parts} as parts))"))
        tree = tree.withColumn(f"best{level}", F.expr(f"map_from_entries(transform(sums{level}, y -> struct(y.x.node, least(y.x.cost, coalesce(y.parts, y.x.cost)))))"))
        done.append(f"sums{level}")
    tree = tree.withColumn("sums", F.concat(*done))
    tree = tree.withColumn("splits", F.expr("map_from_entries(transform(filter(sums, y -> y.parts < y.x.cost), y -> struct(struct(y.x.level as level, y.x.node as node), true)))"))
    above = " and ".join(f"(y.x.level + {i} >= {levels} or coalesce(try_element_at(splits, struct(y.x.level + {i} as level, y.x.node div {4**i} as node)), false))" for i in range(1, levels))
    split = "coalesce(y.parts < y.x.cost, false)"
    kept = "".join(f", y.x.{c} as {c}" for c in keep)
    row = f"struct(y.x.level as level, y.x.node as node, least(y.x.cost, coalesce(y.parts, y.x.cost)) as best, {split} as split, not {split} and {above} as leaf{kept})"
    return tree.select(F.expr(f"inline(transform(sums, y -> {row}))"))
