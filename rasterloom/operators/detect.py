"""Container detection by signature, as column expressions on BINARY."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures that tell a format by themselves, in the order of detection.
FIXED = (
    ("JPEG", ("ffd8ff",)),
    ("PNG", ("89504e470d0a1a0a",)),
    ("GIF", ("474946383761", "474946383961")),
    ("BMP", ("424d",)),
)
TIFF = ("4d4d002a", "49492a00", "4d4d2a00", "4949002a", "4d4d002b", "49492b00")
ICO = ("00000100", "00000200")
WEBP_CHUNKS = ("56503820", "5650384c", "56503858")


def _hex(data: Column, first: int, n: int) -> Column:
    return F.lower(F.hex(F.substring(data, first + 1, n)))


def _starts(data: Column, signatures: tuple[str, ...]) -> Column:
    return _hex(data, 0, len(signatures[0]) // 2).isin(*signatures)


def _be32(data: Column, first: int) -> Column:
    return F.conv(_hex(data, first, 4), 16, 10).cast("bigint")


def _brands(data: Column, size: Column) -> Column:
    """Whether a compatible brand of a file type box is avif or avis."""
    at = F.sequence(F.lit(17), F.greatest(size - 3, F.lit(17)), F.lit(4))
    return F.exists(at, lambda p: F.hex(F.substring(data, p.cast("int"), F.lit(4))).isin("61766966", "61766973"))


def _mif(data: Column) -> Column:
    return _hex(data, 4, 8).isin("667479706d696631", "667479706d736631")


def detect_format(data: Column) -> Column:
    """Format by complete signature; null if unknown."""
    size = _be32(data, 0)
    many = _mif(data) & (size >= 20) & (size <= F.length(data)) & (size % 4 == 0)
    avif = _hex(data, 4, 8).isin("6674797061766966", "6674797061766973") | (many & F.when(many, _brands(data, size)).otherwise(False))
    webp = (_hex(data, 0, 4) == "52494646") & (_hex(data, 8, 4) == "57454250") & _hex(data, 12, 4).isin(*WEBP_CHUNKS)
    known = reduce(lambda c, s: c.when(_starts(data, s[1]), s[0]), FIXED[1:], F.when(_starts(data, FIXED[0][1]), FIXED[0][0]))
    return known.when(webp, "WEBP").when(_starts(data, TIFF), "TIFF").when(_starts(data, ICO), "ICO").when(avif, "AVIF")


def _candidate(data: Column, name: str, signatures: tuple[str, ...]) -> Column:
    """struct<format, minimum>: found, or the bytes that the signature needs, or null."""
    n = len(signatures[0]) // 2
    whole = F.lower(F.hex(data))
    begun = reduce(lambda c, s: c | F.lit(s).startswith(whole), signatures, F.lit(False))
    return F.when(F.length(data) >= n, F.when(_starts(data, signatures), _found(name))).when(begun, _need(F.lit(n)))


def _found(name: str) -> Column:
    return F.struct(F.lit(name).alias("format"), F.lit(None).cast("bigint").alias("minimum"))


def _need(n: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("format"), n.cast("bigint").alias("minimum"))


def detect_prefix(data: Column) -> Column:
    """struct<format, minimum>: the format, else the least total length that can decide, else null (unknown)."""
    n, whole, size = F.length(data), F.lower(F.hex(data)), _be32(data, 0)
    webp = (
        F.when(n < 4, F.when(F.lit("52494646").startswith(whole), _need(F.lit(4))))
        .when(_hex(data, 0, 4) != "52494646", F.lit(None))
        .when(n < 8, _need(F.lit(8)))
        .when(n < 12, F.when(F.lit("57454250").startswith(F.substring(whole, 17, 8)), _need(F.lit(12))))
        .when(_hex(data, 8, 4) != "57454250", F.lit(None))
        .when(n < 16, F.when(reduce(lambda c, s: c | F.lit(s).startswith(F.substring(whole, 25, 8)), WEBP_CHUNKS, F.lit(False)), _need(F.lit(16))))
        .when(_hex(data, 12, 4).isin(*WEBP_CHUNKS), _found("WEBP"))
    )
    avif = (
        F.when(n < 4, _need(F.lit(4)))
        .when(size < 8, F.lit(None))
        .when(n < 12, _need(F.lit(12)))
        .when(_hex(data, 4, 8).isin("6674797061766966", "6674797061766973"), _found("AVIF"))
        .when(~_mif(data) | (size < 20) | (size % 4 != 0), F.lit(None))
        .when(size > n, _need(size))
        .when(_brands(data, F.least(size, n.cast("bigint"))), _found("AVIF"))
    )
    each = [_candidate(data, f, s) for f, s in FIXED] + [webp, _candidate(data, "TIFF", TIFF), _candidate(data, "ICO", ICO), avif]
    formats = F.coalesce(*(c["format"] for c in each))
    minimum = F.least(*(c["minimum"] for c in each))
    return F.when(formats.isNotNull() | minimum.isNotNull(), F.struct(formats.alias("format"), F.when(formats.isNull(), minimum).alias("minimum")))
