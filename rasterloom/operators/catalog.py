"""Formats, modes, capabilities and options as small tables and column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, media types, extensions (canonical first) and verification scopes of the formats.
FORMATS = (
    ("JPEG", "image/jpeg", ("jpg", "jpeg", "jfif", "jpe"), "Structure"),
    ("PNG", "image/png", ("png", "apng"), "Structure"),
    ("GIF", "image/gif", ("gif",), "HeaderOnly"),
    ("BMP", "image/bmp", ("bmp",), "HeaderOnly"),
    ("WEBP", "image/webp", ("webp",), "Structure"),
    ("TIFF", "image/tiff", ("tiff", "tif"), "HeaderOnly"),
    ("ICO", "image/x-icon", ("ico", "cur"), "HeaderOnly"),
    ("AVIF", "image/avif", ("avif", "avifs"), "HeaderOnly"),
)
SCOPES = ("HeaderOnly", "Structure", "FullPixels")
# Transfer mode, colour type, bytes of a pixel (0: packed bits), channels, alpha, colour.
MODES = (
    ("L1", "L8", 0, 1, False, False),
    ("P8", "L8", 1, 1, False, False),
    ("L8", "L8", 1, 1, False, False),
    ("La8", "La8", 2, 2, True, False),
    ("Rgb8", "Rgb8", 3, 3, False, True),
    ("Rgba8", "Rgba8", 4, 4, True, True),
    ("Cmyk8", "Cmyk8", 4, 4, False, True),
    ("L16", "L16", 2, 1, False, False),
    ("La16", "La16", 4, 2, True, False),
    ("Rgb16", "Rgb16", 6, 3, False, True),
    ("Rgba16", "Rgba16", 8, 4, True, True),
    ("F32", "F32", 4, 1, False, False),
    ("I32", "I32", 4, 1, False, False),
    ("Rgb32F", "Rgb32F", 12, 3, False, True),
    ("Rgba32F", "Rgba32F", 16, 4, True, True),
)
# Modes that each encoder takes.
ENCODABLE = {
    "JPEG": ("L1", "L8", "Rgb8", "Cmyk8"),
    "PNG": ("L1", "P8", "L16", "L8", "La8", "Rgb8", "Rgba8"),
    "GIF": ("L1", "P8", "L8", "Rgb8", "Rgba8"),
    "BMP": ("L1", "P8", "L8", "Rgb8", "Rgba8"),
    "TIFF": ("L1", "La8", "L16", "F32", "I32", "L8", "Rgb8", "Rgba8", "Cmyk8"),
    "WEBP": ("L1", "P8", "L8", "L16", "La8", "Rgb8", "Rgba8", "Cmyk8"),
    "ICO": ("Rgb8", "Rgba8"),
    "AVIF": (),
}
OPERATIONS = ("detection", "inspection", "still_decode", "still_encode", "sequence_decode", "sequence_encode")
SEQUENCE_DECODE, SEQUENCE_ENCODE = ("PNG", "GIF", "WEBP", "TIFF"), ("GIF", "WEBP", "TIFF")
# Option keys of each format's encoder.
OPTION_KEYS = {
    "JPEG": ("quality", "progressive", "optimize", "subsampling", "restart_interval", "exif_hex"),
    "PNG": ("compression", "optimize", "interlace", "interlaced", "gamma", "srgb", "physical", "text_chunks", "time"),
    "GIF": ("animated", "interlace", "interlaced", "disposal", "color_table", "transparency", "loop"),
    "BMP": (),
    "TIFF": ("compression", "predictor"),
    "WEBP": ("quality", "lossless", "method", "icc_hex", "exif_hex", "xmp_hex", "kmax", "kmin", "minimize_size", "allow_mixed"),
    "ICO": ("entry_type", "sizes"),
    "AVIF": ("quality", "codec", "subsampling", "range", "speed", "max_threads", "tile_rows", "tile_cols", "alpha_premultiplied", "autotiling", "icc_hex", "exif_hex", "exif_orientation", "xmp_hex", "sequence_time"),
}
MAX_PIXELS, MAX_SIDE, MAX_IFD_ENTRIES = 178_956_970, 16_384, 4_096


def formats(spark: SparkSession) -> DataFrame:
    rows = [(n, m, e[0], ",".join(e), s) for n, m, e, s in FORMATS]
    return spark.createDataFrame(rows, "format string, mime_type string, extension string, extensions string, verification_scope string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, n) for n, _, e, _ in FORMATS for a in e], "alias string, format string")


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODES), "mode string, color string, bytes_per_pixel int, channels int, has_alpha boolean, has_color boolean")


def capabilities(spark: SparkSession, enabled: tuple[str, ...] | None = None) -> DataFrame:
    """48 rows (format, operation, capability, reason) of this engine under a set of enabled formats (None: all).

    Restricted: lossy WebP pixels need the format's tables, and WebP is written without loss."""
    on = F.lit(True) if enabled is None else F.col("format").isin(*enabled)
    ops = spark.createDataFrame([(o, i) for i, o in enumerate(OPERATIONS)], "operation string, operation_no int")
    op, webp = F.col("operation"), F.col("format") == "WEBP"
    absent = (op.isin("still_decode", "still_encode", "sequence_decode", "sequence_encode") & (F.col("format") == "AVIF")) | ((op == "sequence_decode") & ~F.col("format").isin(*SEQUENCE_DECODE)) | ((op == "sequence_encode") & ~F.col("format").isin(*SEQUENCE_ENCODE))
    limited = F.when(webp & op.isin("still_decode", "sequence_decode"), "Vp8Tables").when(webp & op.isin("still_encode", "sequence_encode"), "LosslessOnly")
    reason = F.when(op == "detection", F.lit(None)).when(~on, "FeatureDisabled").when(absent, "NotImplemented").otherwise(limited)
    kind = F.when(F.col("reason").isNull(), "ManifestBounded").when(F.col("reason").isin("Vp8Tables", "LosslessOnly"), "Restricted").otherwise("Unavailable")
    return formats(spark).select("format").crossJoin(F.broadcast(ops)).withColumn("reason", reason).select("format", "operation", kind.alias("capability"), "reason")


def format_of_name(name: Column) -> Column:
    """Format of a name or alias in any ASCII case; null if unknown."""
    low = F.lower(name)
    return reduce(lambda c, f: c.when(low.isin(*f[2]), f[0]), FORMATS[1:], F.when(low.isin(*FORMATS[0][2]), FORMATS[0][0]))


def extension_of_path(path: Column) -> Column:
    """Final extension of a path's last part; empty if there is none (a leading dot starts no extension)."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)/*$", 1)


def provides(scope: Column, requested: Column) -> Column:
    """Whether a verification scope covers the requested one; a stronger request is never downgraded."""
    order = F.array(*(F.lit(s) for s in SCOPES))
    return F.array_position(order, scope) >= F.array_position(order, requested)


def transfer_bytes(mode: Column, width: Column, height: Column) -> Column:
    """Length of a tightly packed raster: rows of packed bits end on bytes."""
    per = reduce(lambda c, m: c.when(mode == m[0], m[2]), MODES[1:], F.when(mode == MODES[0][0], MODES[0][2]))
    w, h = width.cast("bigint"), height.cast("bigint")
    return F.when(mode == "L1", F.floor((w + 7) / 8).cast("bigint") * h).otherwise(w * h * per)
