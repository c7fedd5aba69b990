"""Column expressions: rounding, clipping, bit codes, addressing. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(lo: int, hi: int, x: Column) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round_shift(x: Column, s: int) -> Column:
    """(x + half) >> s, rounding down below zero."""
    return F.shiftright(x + (1 << s - 1), s) if s else x


def bit_length(x: Column) -> Column:
    """Bits of a whole number of 0 or more; 0 has none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def fixed_bits(x: Column, n: int | Column) -> Column:
    return F.lpad(F.bin(x), n, "0") if isinstance(n, int) else F.lpad(F.bin(x), n, F.lit("0"))


def exp_golomb(x: Column) -> Column:
    """Code of a whole number of 0 or more."""
    b = F.bin(x + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def signed_exp_golomb(x: Column) -> Column:
    return exp_golomb(F.when(x > 0, 2 * x - 1).otherwise(-2 * x))


def remainder_code(v: Column, k: Column) -> Column:
    """Code of what is left of a coefficient: a unary prefix and k bits below 3 << k, else an escape that grows by pairs of bits."""
    low = v.cast("long")
    prefix = F.call_function("shiftright", low, k)
    bits = lambda x, n: F.when(n == 0, "").otherwise(F.lpad(F.bin(x), n, F.lit("0")))
    short = F.concat(F.repeat(F.lit("1"), prefix.cast("int")), F.lit("0"), bits(low % F.call_function("shiftleft", F.lit(1).cast("long"), k), k))
    over = prefix - 3 + 1  # at least 1
    more = F.length(F.bin(over)) - 1
    escape = low - F.call_function("shiftleft", F.lit(2).cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), more), k)
    long_ = F.concat(F.repeat(F.lit("1"), more + 3), F.lit("0"), bits(escape, more + k))
    return F.when(prefix < 3, short).otherwise(long_)


def morton_x(z: Column, bits: int = 3) -> Column:
    """Column of a place in Z order."""
    out = F.lit(0)
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, 2 * i).bitwiseAND(1), i))
    return out


def morton_y(z: Column, bits: int = 3) -> Column:
    return morton_x(F.shiftright(z, 1), bits)


def psnr(sse: Column, samples: int | Column) -> Column:
    """Decibels of a sum of squared differences of 8-bit samples; null where there is none."""
    return F.when(sse > 0, 10 * F.log10(F.lit(65025.0) * samples / sse))


#: Chroma QP of the luma QPs 30 to 51.
CHROMA_QP = (29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39)


def chroma_qp(qp: Column) -> Column:
    """QP of the colour planes for luma QPs of 0 to 51."""
    return F.when(qp < 30, qp).otherwise(F.element_at(F.array(*map(F.lit, CHROMA_QP)), F.greatest(F.lit(1), qp - 29)))


def bits_to_hex(bits: Column) -> Column:
    """Bytes of a string of bits whose length is a multiple of 8, as hexadecimal digits."""
    # the string is made once, as an array's only element, and read by 56 bits; a lambda would make it anew for each byte
    word = lambda b, i: F.lpad(F.conv(F.substr(b, (i * 56 + 1).cast("int"), F.lit(56)), 2, 16), F.least(F.lit(14), F.floor(F.length(b) / 4).cast("int") - i * 14), F.lit("0"))
    digits = lambda b: F.when(F.length(b) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.length(b) / 56).cast("int") - 1), lambda i: word(b, i)), ""))
    return F.get(F.transform(F.array(bits), digits), F.lit(0))


def protected_hex(digits: Column) -> Column:
    """Bytes (hexadecimal digits) with a byte 03 before each byte of at most 3 that follows two zero bytes, so that no start code arises."""
    spaced = F.regexp_replace(F.upper(digits), "(..)", "$1 ")
    return F.replace(F.regexp_replace(spaced, "00 00 (?=0[0-3])", "00 00 03 "), F.lit(" "), F.lit(""))
