"""Integer block transforms, quantisation, reconstruction.

Matrices are applied to whole Arrow batches of blocks: one integer matrix product per pass.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import clip

#: Fixed values of the public H.265 specification: first column of the 32-point cosine matrix, the
#: 4-point sine matrix, and the scales of the quantiser and its inverse by QP modulo 6.
COSINE = (64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4)
SINE4 = ((29, 55, 74, 84), (74, 74, 0, -74), (84, -29, -74, 55), (55, -84, 74, -29))
QUANT = (26214, 23302, 20560, 18396, 16384, 14564)
DEQUANT = (40, 45, 51, 57, 64, 72)


def _entry(k: int, x: int) -> int:
    """Entry of the 32-point matrix, by folding the angle (2x + 1)k into the first column."""
    if k == 0:
        return COSINE[0]
    a = (2 * x + 1) * k % 128
    a = 128 - a if a > 64 else a
    return 0 if a == 32 else -COSINE[64 - a] if a > 32 else COSINE[a]


@lru_cache
def matrix(n: int, sine: bool = False) -> np.ndarray:
    if sine:
        return np.array(SINE4, np.int64)
    return np.array([[_entry(k * 32 // n, x) for x in range(n)] for k in range(n)], np.int64)


def _pass(m: np.ndarray, blocks: np.ndarray, shift: int) -> np.ndarray:
    return (m @ blocks + (1 << shift - 1)) >> shift


def forward(blocks: np.ndarray, sine: bool = False) -> np.ndarray:
    """Residual blocks (b, n, n) to coefficients: rows first, then columns."""
    n = blocks.shape[-1]
    m, log = matrix(n, sine), n.bit_length() - 1
    rows = _pass(m, blocks.transpose(0, 2, 1), log - 1).transpose(0, 2, 1)
    return _pass(m, rows, log + 6)


def inverse(blocks: np.ndarray, sine: bool = False) -> np.ndarray:
    """Coefficients to residuals: columns first, saturated to 16 bits, then rows."""
    m = matrix(blocks.shape[-1], sine).T
    cols = np.clip(_pass(m, blocks, 7), -32768, 32767)
    return np.clip(_pass(m, cols.transpose(0, 2, 1), 12).transpose(0, 2, 1), -32768, 32767)


#: Numbers that are worked on at once, so that a worker's memory doesn't follow the rows of a batch.
LOT = 1 << 18


def in_lots(f, x: np.ndarray, sine: bool = False) -> np.ndarray:
    """f of blocks (b, n, n) of any whole numbers."""
    y, step = np.empty(x.shape, np.int32), max(1, LOT // x[0].size if len(x) else 1)
    for i in range(0, len(x), step):
        y[i : i + step] = f(x[i : i + step].astype(np.int64), sine)
    return y


def _on_blocks(f, column: Column, n: int, sine: bool) -> Column:
    def run(arrays: pa.Array) -> pa.Array:
        y = in_lots(f, arrays.flatten().to_numpy(zero_copy_only=False).reshape(-1, n, n), sine).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) + 1, n * n), pa.int32()), pa.array(y))

    return F.arrow_udf(run, "array<int>")(column)


def dct(r: Column, n: int, sine: bool = False) -> Column:
    """Coefficients of residual blocks (array of n * n, none null)."""
    return _on_blocks(forward, r, n, sine)


def idct(c: Column, n: int, sine: bool = False) -> Column:
    return _on_blocks(inverse, c, n, sine)


def quantize(c: Column, qp: int, n: int) -> Column:
    """Levels of coefficients: magnitudes are scaled with the rounding of intra blocks, signs put back, clipped to 16 bits."""
    bits = 14 + qp // 6 + 7 - (n.bit_length() - 1)
    return F.transform(c, lambda x: clip(-32768, 32767, F.signum(x.cast("double")).cast("long") * F.shiftright(F.abs(x).cast("long") * QUANT[qp % 6] + (171 << bits - 9), bits)).cast("int"))


def sum_of_levels(levels: Column) -> Column:
    """Sum of their magnitudes (before clipping they are the same for 16-bit coefficients)."""
    return F.aggregate(levels, F.lit(0).cast("long"), lambda a, x: a + F.abs(x))


def dequantize(levels: Column, qp: int, n: int) -> Column:
    shift = n.bit_length() - 2
    scale = DEQUANT[qp % 6] << qp // 6
    return F.transform(levels, lambda x: clip(-32768, 32767, F.shiftright(x.cast("long") * scale + (1 << shift - 1), shift)).cast("int"))


def reconstruct(prediction: Column, residual: Column) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clip(0, 255, p + r))


def reconstruct_or_predict(prediction: Column, levels: Column, residual: Column) -> Column:
    """As reconstruct(); blocks without levels are their prediction."""
    return F.when(coded(levels), reconstruct(prediction, residual)).otherwise(prediction)


def coded(levels: Column) -> Column:
    """Whether any level isn't 0."""
    return F.exists(levels, lambda x: x != 0)
