"""Parameter sets of a stream as ordered fields, and the bytes that carry them.

A field is (kind, value): "u" with its bits ("u3"), "ue" or "se"; the value is a number, or the name
of a column. Nothing is grouped: a set's bits are one expression over the columns of its stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import bits_to_hex, exp_golomb, fixed_bits, protected_hex, signed_exp_golomb

Field = tuple[str, int | str]
START_CODE = "00000001"

#: The fields of the three parameter sets in their order, each behind its two header bytes.
VIDEO: tuple[Field, ...] = (
    ("u16", 0x3201), ("u3", 0), ("u5", 0), ("ue", 0), ("u1", 0), ("ue", 1), ("ue", 0), ("ue", 0), ("u1", 0),
)
SEQUENCE: tuple[Field, ...] = (
    ("u16", 0x3401), ("u3", 0), ("u5", 0), ("u16", 0), ("u8", 0), ("u32", 0),  # profile and level
    ("ue", 0), ("ue", 0), ("ue", 1), ("u3", 0), ("ue", "width"), ("ue", "height"), ("u1", 0),
    ("ue", 0), ("ue", 0), ("u1", 0),  # depth of samples
    ("ue", "poc_bits_less_4"), ("ue", 1), ("ue", 0), ("ue", 0), ("u1", 1), ("u1", 0),
    ("ue", 0), ("ue", 2), ("ue", 0), ("ue", 3), ("ue", 0), ("ue", 0),  # sizes of blocks from 8 to 32, of transforms from 4 to 32
    ("u1", 0), ("u1", 1), ("u1", 0), ("u1", 0),
    ("ue", 1), ("u1", 0), ("ue", 1), ("ue", 0), ("ue", 0), ("u1", 1), ("u1", 0), ("u1", 0),  # one reference frame
    ("u1", 1), ("u1", 1), ("u1", 1), ("u1", 0),  # a flag for each depth
)
PICTURE: tuple[Field, ...] = (
    ("u16", 0x3601), ("ue", 0), ("ue", 0), ("u1", 0), ("u1", 1), ("ue", 0), ("ue", 0), ("se", 0),
    ("u1", 0), ("u1", 0), ("u1", 0), ("se", 0), ("se", 0), ("u1", 0), ("u1", 0), ("u1", 0), ("u1", 0), ("u1", 0), ("u1", 0),
)
#: Follows PICTURE: whether there are several tiles, and if so their grid; then the rest.
TILES: tuple[Field, ...] = (("u2", 1), ("ue", "cols_less_1"), ("ue", "rows_less_1"), ("u1", 1), ("u1", 0))
NO_TILES: tuple[Field, ...] = (("u2", 0),)
PICTURE_REST: tuple[Field, ...] = (("u1", 0), ("u1", 1), ("u1", 0), ("u1", 0), ("ue", 0), ("u1", 0), ("u1", 0))


def _code(kind: str, name: str) -> Column:
    v = F.col(name)
    if kind in ("ue", "se"):
        return (exp_golomb if kind == "ue" else signed_exp_golomb)(v.cast("long"))
    return fixed_bits(v.cast("long"), int(kind[1:]))


def _fixed(kind: str, value: int) -> str:
    """Bits of a field whose value is known."""
    if kind[1:].isdigit():
        return format(value, f"0{kind[1:]}b")
    code = format((value if kind == "ue" else 2 * value - 1 if value > 0 else -2 * value) + 1, "b")
    return "0" * (len(code) - 1) + code


def bits(fields: Sequence[Field]) -> Column:
    parts: list[str | Column] = []
    for kind, value in fields:
        if isinstance(value, str):
            parts.append(_code(kind, value))
        elif parts and isinstance(parts[-1], str):
            parts[-1] += _fixed(kind, value)
        else:
            parts.append(_fixed(kind, value))
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def closed(b: Column) -> Column:
    """Bits, closed with a 1 and zeros to a whole byte."""
    out = F.concat(b, F.lit("1"))
    return F.rpad(out, F.ceil(F.length(out) / 8).cast("int") * 8, F.lit("0"))


def carried(b: Column) -> Column:
    """Whole bytes behind a start code, as hexadecimal digits that hold no other start code."""
    return F.concat(F.lit(START_CODE), protected_hex(bits_to_hex(b)))


def video_set() -> Column:
    return carried(bits(VIDEO))


def sequence_set() -> Column:
    """Of the columns width, height, poc_bits_less_4."""
    return carried(closed(bits(SEQUENCE)))


def picture_set() -> Column:
    """Of the columns cols_less_1, rows_less_1."""
    tiles = F.when((F.col("cols_less_1") > 0) | (F.col("rows_less_1") > 0), bits(TILES)).otherwise(bits(NO_TILES))
    return carried(closed(F.concat(bits(PICTURE), tiles, bits(PICTURE_REST))))
