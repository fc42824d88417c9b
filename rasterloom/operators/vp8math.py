"""Integer kernels of lossy WebP as column expressions: inverse transforms, edge filter, chroma and colour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.operators.jpegmath import once

# sin(pi / 8) * sqrt(2) and cos(pi / 8) * sqrt(2) - 1 in 16 bits; colour factors in 14 bits and their offsets.
SINE, COSINE = 35468, 20091
LUMA, RED, GREEN_U, GREEN_V, BLUE = 19077, 26149, 6419, 13320, 33050
OFF_RED, OFF_GREEN, OFF_BLUE = -14234, 8708, -17685


def _sine(v: Column) -> Column:
    return F.shiftright(v * SINE, 16)


def _cosine(v: Column) -> Column:
    return v + F.shiftright(v * COSINE, 16)


def _dct4(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    low, high, inner, outer = a + c, a - c, _sine(b) - _cosine(d), _cosine(b) + _sine(d)
    return [low + outer, high + inner, high - inner, low - outer]


def _wht4(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    return [(a + d) + (b + c), (b - c) + (a - d), (a + d) - (b + c), (a - d) - (b - c)]


def _columns_then_rows(block: Column, four: Callable[..., list[Column]], bias: int) -> Column:
    """Of 16 values; the first pass leaves its four outputs of a column side by side, so both read with a stride of 4."""
    def turn(values: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(*four(*(F.get(values, i + 4 * k) for k in range(4))))))

    columns = once(F.transform(block, lambda x: x.cast("bigint")), turn)
    return F.transform(once(columns, turn), lambda x: F.shiftright(x + bias, 3))


def inverse_dct(block: Column) -> Column:
    return _columns_then_rows(block, _dct4, 4)


def inverse_wht(block: Column) -> Column:
    return _columns_then_rows(block, _wht4, 3)


def _signed(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-128)), F.lit(127))


def _byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255))


def simple_filter(p1: Column, p0: Column, q0: Column, q1: Column, limit: int) -> tuple[Column, Column]:
    """The two samples at an edge after the simple loop filter."""
    go = F.abs(p0 - q0) * 2 + F.shiftright(F.abs(p1 - q1), 1) <= limit
    a = _signed(_signed(p1 - q1) + 3 * (q0 - p0))
    up, down = F.shiftright(F.least(a + 3, F.lit(127)), 3), F.shiftright(F.least(a + 4, F.lit(127)), 3)
    return F.when(go, _byte(p0 + up)).otherwise(p0), F.when(go, _byte(q0 - down)).otherwise(q0)


def fancy(near: Column, beside: Column, above: Column, across: Column) -> Column:
    """A chroma sample at full size from the four nearest ones."""
    return F.shiftright(9 * near + 3 * beside + 3 * above + across + 8, 4)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    part = lambda x, k: F.shiftright(x * k, 8)
    level = lambda x: _byte(F.shiftright(x, 6))
    luma = part(y, LUMA)
    return level(luma + part(v, RED) + OFF_RED), level(luma - part(u, GREEN_U) - part(v, GREEN_V) + OFF_GREEN), level(luma + part(u, BLUE) + OFF_BLUE)
