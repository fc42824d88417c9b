"""JPEG tables and integer kernels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The luminance and chrominance quantisation tables of the standard's annex, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def zigzag() -> list[int]:
    """Natural-order place of each zig-zag position: diagonals in turn, every second one upwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return [8 * r + c for r, c in cells]


def quant_scale(quality: Column) -> Column:
    q = F.least(F.greatest(quality, F.lit(1)), F.lit(100))
    return F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q).cast("int")


def scaled_quant(base: Column, quality: Column) -> Column:
    return F.least(F.greatest(F.floor((base * quant_scale(quality) + 50) / 100), F.lit(1)), F.lit(255)).cast("int")


def quantize(v: Column, divisor: Column) -> Column:
    size = F.floor((F.abs(v) + F.shiftright(divisor, 1)) / divisor).cast("int")
    return F.when(v < 0, -size).otherwise(size)


def bit_category(v: Column) -> Column:
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("bigint"))))


def magnitude_bits(v: Column) -> Column:
    mask = F.pow(F.lit(2), bit_category(v)).cast("bigint") - 1
    return F.when(v < 0, v - 1).otherwise(v).cast("bigint").bitwiseAND(mask)


def dc_differences(blocks: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Difference to the DC value before it in the same restart segment."""
    w = Window.partitionBy(*keys).orderBy(order)
    return blocks.withColumn("diff", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def canonical_codes(lengths: DataFrame, keys: tuple[str, ...], symbol: str, length: str, maximum: int = 16) -> DataFrame:
    """Canonical Huffman codes: shorter codes first, symbols in order, counted up and shifted left.

    The code of a symbol is the sum over those before it of 2 ** (maximum - length), cut to its length."""
    w = Window.partitionBy(*keys).orderBy(length, symbol).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.pow(F.lit(2), maximum - F.col(length)).cast("bigint")).over(w), F.lit(0))
    return lengths.withColumn("code", F.floor(before / F.pow(F.lit(2), maximum - F.col(length))).cast("bigint"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed a single time: as the variable of a lambda, not copied into its body."""
    return F.get(F.transform(F.array(value), use), 0)


def _pass(matrix: list[int], values: Column, bits: int, rows: bool, transposed: bool) -> Column:
    """One pass of an 8 x 8 integer transform over an array of 64, rounded by a shift."""
    m = F.array(*(F.lit(int(x)).cast("bigint") for x in matrix))

    def cell(values: Column, i: Column) -> Column:
        y, x = F.floor(i / 8).cast("int"), i % 8
        place = lambda out, k: (k * 8 + out) if transposed else (out * 8 + k)
        term = lambda s, k: s + F.get(m, place(x if rows else y, k)) * F.get(values, y * 8 + k if rows else k * 8 + x)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(1 << (bits - 1)).cast("bigint"), term)
        return F.shiftright(total, bits)

    return once(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: cell(v, i)))


def inverse_dct(block: Column, matrix: list[int]) -> Column:
    """Samples of a block of 64 dequantised coefficients: columns, then rows, in fixed point. The matrix is the
    codec's TRANSFORM, row by row."""
    columns = _pass(matrix, F.transform(block, lambda x: x.cast("bigint")), 11, rows=False, transposed=False)
    samples = _pass(matrix, columns, 18, rows=True, transposed=False)
    return F.transform(samples, lambda x: F.least(F.greatest(x + 128, F.lit(0)), F.lit(255)).cast("int"))


def forward_dct(block: Column, matrix: list[int]) -> Column:
    """8 times the coefficients of a block of 64 samples: rows, then columns, in fixed point."""
    rows = _pass(matrix, F.transform(block, lambda x: x.cast("bigint") - 128), 11, rows=True, transposed=True)
    return F.transform(_pass(matrix, rows, 15, rows=False, transposed=True), lambda x: x.cast("int"))
