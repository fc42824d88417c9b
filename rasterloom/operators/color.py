"""Fixed-point colour arithmetic as column expressions; all integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int")


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    bias = (128 << 16) + 32767
    return (
        F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16),
        F.shiftright(-11059 * r - 21709 * g + 32768 * b + bias, 16),
        F.shiftright(32768 * r - 27439 * g - 5329 * b + bias, 16),
    )


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    u, v = cb - 128, cr - 128
    return (
        clamp(y + F.shiftright(91881 * v + 32768, 16)),
        clamp(y + F.shiftright(-22554 * u - 46802 * v + 32768, 16)),
        clamp(y + F.shiftright(116130 * u + 32768, 16)),
    )


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    return tuple(F.floor(((255 - x) * (255 - k) + 127) / 255).cast("int") for x in (c, m, y))


def webp_luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(16839 * r + 33059 * g + 6420 * b + 32768 + (16 << 16), 16)


def webp_chroma(r4: Column, g4: Column, b4: Column) -> tuple[Column, Column]:
    """From sums of four samples."""
    half = (128 << 18) + (1 << 17)
    return clamp(F.shiftright(-9719 * r4 - 19081 * g4 + 28800 * b4 + half, 18)), clamp(F.shiftright(28800 * r4 - 24116 * g4 - 4684 * b4 + half, 18))


def _int8(v: Column) -> Column:
    return F.when(v >= 128, v - 256).otherwise(v)


def cross_color_delta(t: Column, c: Column) -> Column:
    return F.shiftright(_int8(t) * _int8(c), 5)


def undo_cross_color(r: Column, g: Column, b: Column, g2r: int, g2b: int, r2b: int) -> tuple[Column, Column]:
    """Red and blue of a pixel whose channels were predicted from each other."""
    red = F.pmod(r + cross_color_delta(F.lit(g2r), g), F.lit(256))
    blue = F.pmod(b + cross_color_delta(F.lit(g2b), g) + cross_color_delta(F.lit(r2b), red), F.lit(256))
    return red, blue


def blend_byte(over: Column, under: Column, alpha: Column) -> Column:
    """One channel of a PNG frame over its canvas."""
    t = under * (255 - alpha) + over * alpha + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def blend_unmultiplied(s: Column, sa: Column, d: Column, da: Column) -> tuple[Column, Column]:
    """(channel, alpha) of a WebP frame over its canvas, channels not multiplied by alpha."""
    f = F.shiftright(da * (256 - sa), 8)
    a = sa + f
    scale = F.floor(F.lit(1 << 24).cast("bigint") / a).cast("bigint")
    mixed = F.shiftright(((s * sa + d * f).cast("bigint") * scale) % (1 << 32), 24).cast("int")
    return F.when(sa == 0, d).when((da == 0) | (sa == 255), s).otherwise(mixed), F.when(sa == 0, da).when(da == 0, sa).when(sa == 255, F.lit(255)).otherwise(a)


def bt601_full_range(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    level = F.shiftright((y * 0x0101).cast("bigint") * 16320, 16)
    return (
        clamp(F.shiftright(level + 90 * v - 11488, 6)),
        clamp(F.shiftright(level + 8736 - (22 * u + 46 * v), 6)),
        clamp(F.shiftright(level + 113 * u - 14432, 6)),
    )


def bitfield(pixel: Column, mask: int) -> Column:
    """A channel under a BMP mask: narrow ones scaled to a byte, wide ones cut to their high bits."""
    shift = (mask & -mask).bit_length() - 1
    width = mask.bit_length() - shift
    v = F.shiftright(pixel.bitwiseAND(mask), shift)
    return (F.shiftright(v, width - 8) if width >= 8 else F.floor(v * 255 / ((1 << width) - 1))).cast("int")
