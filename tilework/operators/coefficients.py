"""Bins of coefficient blocks, with their contexts.

A block's levels are taken in scan order and coded backwards from the last one that isn't 0, in
groups of 16 places. Whatever a bin depends on comes before it in the same block: neighbouring
groups' flags, levels already seen in the group, the group before. All of it is array
expressions in the JVM, and blocks are independent of each other. The parameter of the remainder's code
adapts from level to level; it is the state of a fold over the levels of a group.

Contexts are numbered within their element; ``context_table`` has where each element's contexts
begin among all, and their initial values, as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bit_length, remainder_code
from .entropy import context_state, significance_context
from .geometry import scan_kind, scan_order

GROUP, FLAGS = 16, 8
#: Fixed values of the public specification's draft: elements of intra slices with the number of their first context among all, and initial values.
CONTEXTS = (
    ("split", 0, (139, 141, 157)),
    ("part", 9, (184, 154, 154, 154)),
    ("luma_mode", 15, (184,)),
    ("chroma_mode", 16, (63, 139)),
    ("coded", 29, (111, 141, 154, 154, 154, 94, 138, 182, 154, 154)),
    ("group", 40, (91, 171, 134, 141)),
    ("significant", 44, (111, 111, 125, 110, 110, 94, 124, 108, 124, 107, 125, 141, 179, 153, 125, 107, 125, 141, 179, 153, 125, 107, 125, 141, 179, 153, 125, 140, 139, 182, 182, 152, 136, 152, 136, 153, 136, 139, 111, 136, 139, 111)),
    ("last_x", 86, (110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63)),
    ("last_y", 116, (110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63)),
    ("over_one", 146, (140, 92, 137, 138, 140, 152, 138, 139, 153, 74, 149, 92, 139, 107, 122, 152, 140, 179, 166, 182, 140, 227, 122, 197)),
    ("over_two", 170, (138, 153, 136, 167, 152, 152)),
)
#: Where colour blocks' contexts begin within an element.
COLOUR = {"coded": 5, "group": 2, "significant": 27, "last_x": 15, "last_y": 15, "over_one": 16, "over_two": 4}


def context_table(spark: SparkSession) -> DataFrame:
    """element, first, size, values: a row per element of intra slices."""
    return spark.createDataFrame([(e, first, len(v), list(v)) for e, first, v in CONTEXTS], "element string, first int, size int, values array<int>")


def with_contexts(bins: DataFrame, table: DataFrame, qp: Column) -> DataFrame:
    """A row per bin that has a context (bins: element, bins, ctx and whatever else): i (place in its string), bin, context (number among all) and state (initial, at that QP). The table has a row per element."""
    each = bins.where("ctx is not null").withColumn("each", F.arrays_zip(F.split("bins", "").alias("bin"), F.col("ctx").alias("c"))).select("*", F.posexplode("each").alias("i", "b")).drop("bins", "ctx", "each")
    met = each.join(F.broadcast(table), "element")
    known = met.where((F.col("b.c") >= 0) & (F.col("b.c") < F.col("size")))
    state = context_state(F.get("values", F.col("b.c")), qp)
    return known.select(*[c for c in bins.columns if c not in ("bins", "ctx")], "i", F.col("b.bin").cast("int").alias("bin"), (F.col("first") + F.col("b.c")).alias("context"), state.alias("state"))


def scan_arrays(spark: SparkSession) -> DataFrame:
    """n, kind, scan (places in raster order, as they are scanned), groups (raster numbers of the groups, as scanned), at (the inverse of groups): twelve rows."""
    order = scan_order(spark).withColumn("p", F.col("y") * F.col("n") + F.col("x"))
    whole = order.groupBy("n", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "p", "y", "x"))).alias("o"))
    first = F.filter("o", lambda s: s["pos"] % GROUP == 0)
    groups = F.transform(first, lambda s: (F.floor(s["y"] / 4) * F.floor(F.col("n") / 4) + F.floor(s["x"] / 4)).cast("int"))
    at = F.transform(F.array_sort(F.transform("groups", lambda g, i: F.struct(g.alias("g"), i.alias("i")))), lambda s: s["i"])
    return whole.select("n", "kind", F.transform("o", lambda s: s["p"]).alias("scan"), groups.alias("groups")).withColumn("at", at)


def scan_contexts(spark: SparkSession) -> DataFrame:
    """scan_arrays with luma_ctx and colour_ctx: by group as scanned and pattern of its neighbours' flags, the contexts of significance of its 16 places, last one first."""
    p = lambda g, j: F.get("scan", g * GROUP + GROUP - 1 - j)
    x, y = lambda p: (p % F.col("n")).cast("int"), lambda p: F.floor(p / F.col("n")).cast("int")
    one = lambda p, pattern, luma: (significance_context(pattern, F.col("kind"), x(p), y(p), F.col("n"), F.lit(luma)) + (0 if luma else COLOUR["significant"])).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    all_ = lambda luma: F.transform("groups", lambda _, g: F.transform(upto(4), lambda pattern: F.transform(upto(GROUP), lambda j: one(p(g, j), pattern, luma))))
    return scan_arrays(spark).withColumns({"luma_ctx": all_(True), "colour_ctx": all_(False)})


def _last_prefix(v: Column, n: Column) -> Column:
    group = _last_group(v)
    return F.concat(F.repeat(F.lit("1"), group), F.when(group < 2 * (bit_length(n) - 1) - 1, "0").otherwise(""))


def _last_group(v: Column) -> Column:
    return F.when(v < 4, v).otherwise(2 * (bit_length(v) - 1) + F.call_function("shiftright", v, bit_length(v) - 2) % 2).cast("int")


def _last_suffix(v: Column) -> Column:
    group = _last_group(v)
    bits = F.greatest(F.call_function("shiftright", group - 2, F.lit(1)), F.lit(0))
    return F.when(group > 3, F.lpad(F.bin(v - F.call_function("shiftleft", 2 + group % 2, bits)), bits, F.lit("0"))).otherwise("")


def _last_contexts(prefix: Column, n: Column, luma: Column) -> Column:
    log = bit_length(n) - 1
    offset = F.when(luma, (log - 2) * 3 + F.call_function("shiftright", log - 1, F.lit(2))).otherwise(COLOUR["last_x"])
    shift = F.when(luma, F.call_function("shiftright", log + 1, F.lit(2))).otherwise(log - 2)
    return F.when(prefix == "", F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.length(prefix) - 1), lambda i: (offset + F.call_function("shiftright", i, shift)).cast("int")))


def coefficient_bins(blocks: DataFrame, *by: str) -> DataFrame:
    """by, grp, ord, element, bins, ctx for blocks (by, n, mode, luma, level: n * n in raster order).

    grp counts down with the groups of a block from 1,024 for the last position's parts, and ord goes up within one. bins is a string; ctx has the context of each of its bins, or is null where they have none. Blocks without levels have no rows.
    """
    spark = blocks.sparkSession
    own = blocks.select(F.struct(*by).alias("__by"), "n", "mode", "luma", "level")  # whatever the names in by
    x = own.withColumn("kind", scan_kind(F.col("n"), F.col("mode"), F.col("luma")))
    x = x.join(F.broadcast(scan_contexts(spark)), ["n", "kind"])
    x = x.withColumn("contexts", F.when(F.col("luma"), F.col("luma_ctx")).otherwise(F.col("colour_ctx")))
    # blocks without levels have none of what follows; a filter would go down to where levels are made, and make them twice
    x = x.withColumn("s", F.when(F.exists("level", lambda v: v != 0), F.transform("scan", lambda p: F.get("level", p))))
    # of each level as scanned, the bin that says whether it isn't 0
    x = x.withColumn("bits", F.transform("s", lambda v: F.when(v != 0, "1").when(v == 0, "0")))
    x = x.withColumn("last", F.size("s") - F.array_position(F.reverse("bits"), "1").cast("int"))
    x = x.withColumn("flags", F.transform("groups", lambda _, g: F.array_contains(F.slice("bits", g * GROUP + 1, GROUP), "1")))
    w, end = F.expr("n div 4").cast("int"), F.expr(f"last div {GROUP}").cast("int")
    flag = lambda raster: F.coalesce(F.get("flags", F.get("at", raster)), F.lit(False))

    def group(g: Column) -> Column:
        c = F.get("groups", g)
        pattern = ((c % w < w - 1) & flag(c + 1)).cast("int") + 2 * flag(c + w).cast("int")
        many = F.when(g == end, F.col("last") % GROUP + 1).otherwise(GROUP)
        back = lambda a: F.reverse(F.slice(a, g * GROUP + 1, many))
        return F.struct(g.alias("g"), pattern.alias("pattern"), F.get("flags", g).alias("flag"), back("s").alias("vals"), back("bits").alias("bits"), F.get("contexts", g).alias("contexts"))

    x = x.withColumn("parts", F.transform(F.sequence(end, F.lit(0), F.lit(-1)), group))
    # of each group, its levels that aren't 0, and which of those with flags is the first over 1 (0: none)
    x = x.withColumn("found", F.transform("parts", lambda q: F.filter(q["vals"], lambda v: v != 0)))
    x = x.withColumn("over", F.transform("found", lambda a: F.array_position(F.transform(F.slice(a, 1, FLAGS), lambda v: F.abs(v) > 1), True).cast("int")))
    # whether the last group with levels before it has one over 1: twice its number, and one more if so
    x = x.withColumn("marks", F.transform(F.arrays_zip("found", "over"), lambda q, i: F.when(F.size(q["found"]) > 0, 2 * i + (q["over"] > 0).cast("int"))))
    x = x.withColumn("carry", F.transform("marks", lambda _, i: F.coalesce(F.array_max(F.slice("marks", F.lit(1), i)) % 2, F.lit(0))))
    last_p = F.get("scan", F.col("last"))
    lx, ly = last_p % F.col("n"), F.expr("element_at(scan, last + 1) div n").cast("int")
    x = x.withColumns({"lx": F.when(F.col("kind") == "ver", ly).otherwise(lx), "ly": F.when(F.col("kind") == "ver", lx).otherwise(ly)})
    keep = ["__by", "n", "luma", "lx", "ly"]
    x = x.select(*keep, F.posexplode(F.arrays_zip("parts", "found", "over", "carry")).alias("k", "z"))
    x = x.select(*keep, "k", "z.found", "z.over", "z.carry", "z.parts.*")

    colour = lambda e: F.when(F.col("luma"), 0).otherwise(COLOUR[e])
    g, is_end = F.col("g"), F.col("k") == 0
    coded = is_end | (g == 0) | F.col("flag")
    # no flag for the last level, nor for a group's last place where all before it are 0
    here, first = F.size("bits"), is_end.cast("int")
    said = (g != 0) & ~F.coalesce(F.array_contains(F.slice("bits", F.lit(1), here - 1), "1"), F.lit(False))
    x = x.withColumns({"here": here, "first": first, "flagged": F.greatest(here - first - said.cast("int"), F.lit(0))})
    contexts = F.get("contexts", F.col("pattern"))
    x = x.withColumn("abs", F.transform("found", lambda v: F.abs(v)))
    some, any1, flags = F.size("abs") > 0, F.col("over") > 0, F.least(F.size("abs"), F.lit(FLAGS))
    # flags count up to the first level over 1, and are 0 after it
    upto = F.when(any1, F.col("over"))
    set_ = F.when((g > 0) & F.col("luma"), 2).otherwise(0) + F.col("carry")
    base = set_ * 4 + colour("over_one")
    ones_ctx = F.concat(F.slice(F.array(*[base + min(i + 1, 3) for i in range(FLAGS)]), F.lit(1), F.coalesce(upto, flags)), F.array_repeat(base, flags - F.coalesce(upto, flags)))
    two = F.when(some & any1, F.when(F.get("abs", F.col("over") - 1) > 2, "1").otherwise("0"))
    # what the flags say of each level
    known = F.coalesce(upto, F.lit(FLAGS))
    told = F.concat(F.array_repeat(F.lit(3), known), F.array_repeat(F.lit(2), FLAGS - known), F.array_repeat(F.lit(1), GROUP - FLAGS))
    left = F.filter(F.zip_with("abs", F.slice(told, F.lit(1), F.size("abs")), lambda a, b: F.struct(a.cast("int").alias("a"), (a - b).cast("long").alias("rest"))), lambda q: q["rest"] >= 0)
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    fold = lambda s, q: F.struct(F.when((q["a"] > F.call_function("shiftleft", F.lit(3), s["k"])) & (s["k"] < 4), s["k"] + 1).otherwise(s["k"]).alias("k"), F.concat(s["out"], remainder_code(q["rest"], s["k"])).alias("out"))
    rest = F.aggregate(F.when(some & (any1 | (F.size("abs") > FLAGS)), left), start, fold)["out"]

    n, luma = F.col("n"), F.col("luma")
    text = lambda a: F.array_join(a, "")
    ints = lambda a: a.cast("array<int>")
    x = x.withColumns({"xs": F.when(is_end, _last_prefix(F.col("lx"), n)), "ys": F.when(is_end, _last_prefix(F.col("ly"), n))})
    none = F.lit(None).cast("array<int>")
    head = F.lit(1 << 10)  # before all groups
    rows = [
        (head, 0, "last_x", F.col("xs"), _last_contexts(F.col("xs"), n, luma)),
        (head, 1, "last_y", F.col("ys"), _last_contexts(F.col("ys"), n, luma)),
        (head, 2, "last_x_rest", F.when(is_end, _last_suffix(F.col("lx"))), none),
        (head, 3, "last_y_rest", F.when(is_end, _last_suffix(F.col("ly"))), none),
        (g, 0, "group", F.when(~is_end & (g != 0), F.col("flag").cast("int").cast("string")), F.array((F.col("pattern") > 0).cast("int") + colour("group"))),
        (g, 1, "significant", F.when(coded, text(F.slice("bits", F.col("first") + 1, F.col("flagged")))), F.slice(contexts, GROUP - F.col("here") + F.col("first") + 1, F.col("flagged"))),
        (g, 2, "over_one", F.when(some, text(F.transform(F.slice("abs", 1, FLAGS), lambda a: F.when(a > 1, "1").otherwise("0")))), ones_ctx),
        (g, 3, "over_two", two, F.array(set_ + colour("over_two"))),
        (g, 4, "sign", F.when(some, text(F.transform("found", lambda v: F.when(v < 0, "1").otherwise("0")))), none),
        (g, 5, "rest", rest, none),
    ]
    # all but their dealing to rows is done in a projection, which is compiled
    x = x.select("__by", "g", *[c for _, _, e, b, ctx in rows for c in (b.alias(f"{e}_bins"), ints(ctx).alias(f"{e}_ctx"))])
    row = lambda grp, i, e: F.struct(grp.cast("int").alias("grp"), F.lit(i).alias("ord"), F.lit(e).alias("element"), F.col(f"{e}_bins").alias("bins"), F.col(f"{e}_ctx").alias("ctx"))
    return x.select("__by", F.inline(F.array(*[row(grp, i, e) for grp, i, e, *_ in rows]))).where("bins != ''").select("__by.*", "grp", "ord", "element", "bins", "ctx")
