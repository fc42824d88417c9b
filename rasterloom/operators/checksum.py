"""Checksums and stored-block framing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE = 65_536


def sums_of(blob: bytes) -> tuple[int, int, int]:
    """Number of bytes n, their sum, and the sum of (n - pos) * byte less multiples of 65,521; PIECE bytes at a time."""
    b = np.frombuffer(blob, np.uint8)
    n, total, weighted = len(b), 0, 0
    for at in range(0, n, PIECE):
        part = b[at : at + PIECE].astype(np.int64)
        own = int(part.sum())
        total += own
        weighted += (n - at) * own - int(part @ np.arange(len(part)))
    return n, total, weighted % 65521


def byte_sums(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n, total, weighted) of each row's binary, as adler32 takes them: three numbers a row leave Python."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([rows.schema[key], *StructType.fromDDL("n bigint, total bigint, weighted bigint").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [sums_of(x.as_buffer() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in sums], pa.int64()) for i in range(3))], schema=arrow)

    return rows.select(key, content).mapInArrow(run, out)


def adler32(total: Column, weighted: Column, n: Column) -> Column:
    """From the sum of n bytes and the sum of (n - pos) * byte: associative parts, so it aggregates map-side."""
    a = (1 + total) % 65521
    b = (n + weighted) % 65521
    return F.shiftleft(b.cast("bigint"), 16) + a


def zlib_stored_length(n: Column, block: int = 65535) -> Column:
    """Bytes of a zlib stream of stored blocks: header, five bytes a block (one at least), checksum."""
    blocks = F.greatest(F.ceil(n / block), F.lit(1))
    return (2 + 5 * blocks + n + 4).cast("bigint")


def zlib_stored(digits: Column, block: int = 65535) -> Column:
    """The zlib stream of stored blocks, in hexadecimal digits, of bytes in hexadecimal digits."""
    n = F.floor(F.length(digits) / 2).cast("bigint")
    byte = lambda i: F.conv(F.substring(digits, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")
    order = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    sums = F.aggregate(order, F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")), lambda s, i: F.struct((s["a"] + byte(i)).alias("a"), (s["b"] + (n - i) * byte(i)).alias("b")))
    little = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256).cast("bigint")), 2, "0"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(n - 1, F.lit(0)) / block).cast("bigint"))

    def stored(i: Column) -> Column:
        size = F.least(n - i * block, F.lit(block))
        last = F.when((i + 1) * block >= n, "01").otherwise("00")
        return F.concat(last, little(size), little(65535 - size), F.substring(digits, (2 * block * i + 1).cast("int"), (2 * size).cast("int")))

    return F.concat(F.lit("7801"), F.array_join(F.transform(blocks, stored), ""), F.lpad(F.hex(adler32(sums["a"], sums["b"], n)), 8, "0"))


def png_output_length(width: Column, height: Column, bytes_per_pixel: int) -> Column:
    """Bytes of a PNG whose scanlines are stored: signature, IHDR, one IDAT, IEND."""
    raw = (width * bytes_per_pixel + 1) * height
    return 8 + 25 + 12 + zlib_stored_length(raw) + 12
