"""Container layouts as column expressions and joins: BMP, ICO, TIFF, GIF, PNG chunks, item graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def le_hex(value: Column, size: int) -> Column:
    """Little-endian hex of a non-negative integer."""
    h = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)))


def bmp_stride(width: Column, bits: int) -> Column:
    return (F.floor((width * bits + 31) / 32) * 4).cast("bigint")


def bmp_size(width: Column, height: Column, bits: int, colors: int) -> Column:
    return 54 + 4 * colors + bmp_stride(width, bits) * height


def bmp_encode_rgb(pixels: DataFrame) -> DataFrame:
    """(image_id, bmp_hex): a whole file from (image_id, y, x, r, g, b): bottom-up rows of B, G, R padded to four bytes.

    Rows are put together first and images from rows, so an aggregation holds one row's pixels or one image's rows."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    cell = F.concat(two("b"), two("g"), two("r"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", cell.alias("h")))), lambda p: p["h"]), "")
    rows = pixels.groupBy("image_id", "y").agg(row.alias("row"), F.count(F.lit(1)).alias("w"))
    rows = rows.withColumn("row", F.concat("row", F.repeat(F.lit("00"), (bmp_stride(F.col("w"), 24) - F.col("w") * 3).cast("int"))))
    images = rows.groupBy("image_id").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("h"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("o"), "row"))), lambda r: r["row"]).alias("rows"))
    data = bmp_stride(F.col("w"), 24) * F.col("h")
    n = lambda v, size=4: le_hex(F.lit(v) if isinstance(v, int) else v, size)
    head = F.concat(F.lit("424D"), n(54 + data), n(0), n(54), n(40), n(F.col("w")), n(F.col("h")), n(1, 2), n(24, 2), n(0), n(data), n(3780), n(3780), n(0), n(0))
    return images.select("image_id", F.concat(head, F.array_join("rows", "")).alias("bmp_hex"))


def ico_best_entry(entries: DataFrame, key: str) -> DataFrame:
    """The entry of the largest area of each icon, 0 standing for 256, the first of equals."""
    side = lambda c: F.when(F.col(c) == 0, 256).otherwise(F.col(c))
    area = side("w") * side("h")
    best = F.max(F.struct(area.alias("area"), (-F.col("idx")).alias("neg"))).alias("m")
    return entries.groupBy(key).agg(best).select(key, (-F.col("m.neg")).alias("idx"), F.col("m.area").alias("area"))


def ico_directory(width: Column, height: Column, bits: Column, size: Column) -> Column:
    """Hex of an icon file's header and its one directory entry."""
    byte = lambda c: le_hex(F.when(c >= 256, 0).otherwise(c), 1)
    return F.concat(F.lit("000001000100"), byte(width), byte(height), F.lit("00000100"), le_hex(bits, 2), le_hex(size, 4), le_hex(F.lit(22), 4))


def tiff_layout(photometric: Column, samples: Column, bits: Column, sample_format: Column) -> Column:
    """Transfer mode of a TIFF directory, null where it has none."""
    p, s, b, f = photometric, samples, bits, sample_format
    return (
        F.when((s == 1) & (b == 1) & p.isin(0, 1), "L1")
        .when((s == 1) & (b == 32) & (f == 3), "F32")
        .when((s == 1) & (b == 32) & (f == 2), "I32")
        .when((s == 1) & (b == 16) & p.isin(0, 1), "L16")
        .when((s == 1) & b.isin(2, 4, 8) & p.isin(0, 1), "L8")
        .when((s == 1) & b.isin(1, 2, 4, 8) & (p == 3), "P8")
        .when((s == 2) & (b == 8) & p.isin(0, 1), "La8")
        .when((s == 3) & (b == 8) & p.isin(2, 6), "Rgb8")
        .when((s == 4) & (b == 8) & (p == 2), "Rgba8")
        .when((s == 4) & (b == 8) & (p == 5), "Cmyk8")
    )


def relocate_pages(pages: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Start of each page, on 16-byte bounds after the page before: a running sum of the sizes before, each
    rounded up to 16, which equals rounding the ends one after another."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    aligned = (F.floor((F.col(size) + 15) / 16) * 16).cast("bigint")
    return pages.withColumn("base", F.coalesce(F.sum(aligned).over(w), F.lit(0))).withColumn("end", F.col("base") + F.col(size))


def gif_table(entries: Column) -> tuple[Column, Column]:
    """(colours, size field) of a colour table: the next power of two of at least four."""
    log = F.length(F.bin((F.greatest(entries, F.lit(4)) - 1).cast("bigint")))
    return F.pow(F.lit(2), log).cast("int"), (log - 1).cast("int")


def chunk_class(kind: Column) -> Column:
    """Class of a PNG chunk: what the decoder interprets, keeps as metadata or colour facts, or keeps whole if ancillary."""
    interpreted = kind.isin("IHDR", "PLTE", "tRNS", "IDAT", "IEND", "acTL", "fcTL", "fdAT")
    color = kind.isin("cHRM", "gAMA", "iCCP", "sRGB", "cICP", "cLLI", "mDCV")
    metadata = kind.isin("tEXt", "zTXt", "iTXt", "eXIf", "tIME", "pHYs")
    ancillary = F.substring(kind, 1, 1) != F.upper(F.substring(kind, 1, 1))
    return F.when(interpreted, "interpreted").when(color, "color").when(metadata, "metadata").when(ancillary, "opaque").otherwise("critical")


def covered_bytes(extents: DataFrame, key: str) -> DataFrame:
    """(key, covered): bytes in the union of [start, end) extents, by a running maximum of ends."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(w), F.lit(-1))
    gain = F.greatest(F.col("end") - F.greatest(before, F.col("start")), F.lit(0))
    return extents.withColumn("gain", gain).groupBy(key).agg(F.sum("gain").alias("covered"))


def run_starts(runs: DataFrame, key: str, order: str, count: str) -> DataFrame:
    """Run-length table to ranges: first and last (exclusive) sample of each run."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("last", F.sum(count).over(w)).withColumn("first", F.col("last") - F.col(count))


#: Well-formed lengths of PNG colour chunks of fixed size.
COLOR_LENGTHS = {"sRGB": 1, "gAMA": 4, "cHRM": 32}


def first_color_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """chunks(key, ordinal, kind, digits: the payload in hexadecimal) with `role`: color for the first well-formed
    one of its kind, metadata for the others."""
    n, nul = F.length("digits") / 2, F.expr("regexp_instr(digits, '^(..)*?00') > 0 AND left(digits, 2) <> '00' AND NOT digits rlike '^(([1-9A-F].)|(0[1-9A-F]))*00$'")
    fixed = reduce(lambda c, x: c.when(F.col("kind") == x[0], n == x[1]), list(COLOR_LENGTHS.items())[1:], F.when(F.col("kind") == "sRGB", (n == 1) & F.col("digits").isin("00", "01", "02", "03")))
    good = F.coalesce(fixed.when(F.col("kind") == "iCCP", nul), F.lit(False))
    first = F.min(F.when(F.col("good"), F.col("ordinal"))).over(Window.partitionBy(key, "kind"))
    return chunks.withColumn("good", good).withColumn("role", F.when(F.col("good") & (F.col("ordinal") == first), "color").otherwise("metadata")).drop("good")


def obu_header(byte: Column) -> Column:
    """Fields of the first byte of an AV1 unit."""
    part = lambda shift, mask: F.shiftright(byte, shift).bitwiseAND(F.lit(mask))
    return F.struct((part(7, 1) == 1).alias("forbidden"), part(3, 15).alias("type"), (part(2, 1) == 1).alias("extended"), (part(1, 1) == 1).alias("sized"))


def leb128(value: Column) -> Column:
    """A number in groups of seven bits, lowest first, in hexadecimal digits."""
    groups = F.sequence(F.lit(0), F.floor((F.greatest(F.length(F.bin(value)), F.lit(1)) - 1) / 7).cast("int"))
    group = lambda i: F.floor(value / F.pow(F.lit(128), i)).cast("bigint") % 128 + F.when(i < F.size(groups) - 1, 128).otherwise(0)
    return F.array_join(F.transform(groups, lambda i: F.lpad(F.hex(group(i)), 2, "0")), "")
