"""Scanline filters, predictors, bit packing and layouts over exploded samples (image_id, y, x, v)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def in_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def neighbours(samples: DataFrame) -> DataFrame:
    """samples with left, up and upper-left values, 0 outside the image.

    Rows are re-partitioned by image row once, for `left`; the row above comes by an equi-join on (image, y),
    which splits by row, so one huge image is no single partition."""
    left = F.coalesce(F.lag("v").over(in_row()), F.lit(0))
    own = samples.withColumn("l", left)
    above = own.select("image_id", (F.col("y") + 1).alias("y"), "x", F.col("v").alias("u"), F.col("l").alias("ul"))
    return own.join(above, ["image_id", "y", "x"], "left").na.fill(0, ["u", "ul"])


def paeth(left: Column, up: Column, corner: Column) -> Column:
    a, b, c = F.abs(up - corner), F.abs(left - corner), F.abs(left + up - 2 * corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def predictions() -> dict[str, Column]:
    """Predicted value of each PNG filter, in the order of preference."""
    left, up, corner = F.col("l"), F.col("u"), F.col("ul")
    return {"none": F.lit(0), "up": up, "sub": left, "average": F.shiftright(left + up, 1), "paeth": paeth(left, up, corner)}


def residual(prediction: Column) -> Column:
    return F.pmod(F.col("v") - prediction, F.lit(256))


def signed_size(byte: Column) -> Column:
    """|int8(byte)|"""
    return F.when(byte >= 128, 256 - byte).otherwise(byte)


def filter_scores(samples: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """(image_id, y, <filter>...): sums of residual sizes, all filters in one aggregation."""
    p = predictions()
    return neighbours(samples).groupBy("image_id", "y").agg(*(F.sum(signed_size(residual(p[f]))).cast("bigint").alias(f) for f in filters))


def select_filter(samples: DataFrame, optimize: bool = False) -> DataFrame:
    """(image_id, y, filter, score): the least score; ties go to the first of None, Up, Sub, [Average], Paeth."""
    order = ("none", "up", "sub", "average", "paeth") if optimize else ("none", "up", "sub", "paeth")
    scores = filter_scores(samples, order)
    best = F.array_min(F.array(*(F.struct(F.col(f).alias("score"), F.lit(i).alias("i"), F.lit(f).alias("filter")) for i, f in enumerate(order))))
    return scores.select("image_id", "y", best.alias("b")).select("image_id", "y", "b.filter", "b.score")


def predictor_apply(samples: DataFrame, bits: int = 8) -> DataFrame:
    return samples.withColumn("d", F.pmod(F.col("v") - F.coalesce(F.lag("v").over(in_row()), F.lit(0)), F.lit(1 << bits)).cast("int"))


def predictor_reverse(samples: DataFrame, column: str = "d", bits: int = 8) -> DataFrame:
    running = F.sum(column).over(in_row().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return samples.withColumn("restored", (running % (1 << bits)).cast("int"))


def pack_bits(samples: DataFrame, bit: Column) -> DataFrame:
    """(image_id, y, byte_no, byte): eight samples in a byte, the first in the high bit."""
    rows = samples.select("image_id", "y", F.expr("x div 8").alias("byte_no"), (F.pow(F.lit(2), 7 - F.col("x") % 8).cast("bigint") * bit).alias("b"))
    return rows.groupBy("image_id", "y", "byte_no").agg(F.sum("b").cast("bigint").alias("byte"))


def unpack_index(byte: str, k: int, bits: int) -> Column:
    """k-th index of `bits` bits in a byte, high bits first."""
    return F.shiftright(byte, 8 - bits - bits * k).bitwiseAND((1 << bits) - 1)


def scale_to_byte(value: Column, bits: int) -> Column:
    return F.floor(value * 255 / ((1 << bits) - 1)).cast("int")


# First column, first row, column step and row step of the seven interlace passes.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def adam7_pass(x: Column, y: Column) -> Column:
    """Number (from 1) of the pass that has the pixel: the first whose grid holds it."""
    c = None
    for i, (x0, y0, dx, dy) in enumerate(ADAM7, 1):
        hit = (x >= x0) & (y >= y0) & ((x - x0) % dx == 0) & ((y - y0) % dy == 0)
        c = F.when(hit, i) if c is None else c.when(hit, i)
    return c


# First row and row step of the four interlace passes.
GIF_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def gif_pass(y: Column) -> Column:
    return F.when(y % 8 == 0, 0).when(y % 8 == 4, 1).when(y % 4 == 2, 2).otherwise(3)


RUN_ROWS, RUN_BYTES = 65_536, 65_536


def runs_of(blobs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the blob, start, value, length) of the runs of equal bytes, as columns of at most RUN_ROWS + RUN_BYTES rows.

    Blobs are read RUN_BYTES at a time, a run that goes on is carried over."""
    parts, rows = [], 0
    for n, blob in enumerate(blobs):
        b = np.frombuffer(blob, np.uint8)
        start = 0  # of the run that isn't over
        for at in range(0, len(b), RUN_BYTES):
            end = min(at + RUN_BYTES, len(b))
            new = np.flatnonzero(b[max(at, 1) : end] != b[max(at, 1) - 1 : end - 1]) + max(at, 1)
            edges = np.concatenate([[start], new, [len(b)] if end == len(b) else []]).astype(np.int64)
            start = int(edges[-1])
            parts.append((np.full(len(edges) - 1, n), edges[:-1], b[edges[:-1]], np.diff(edges)))
            rows += len(edges) - 1
            if rows >= RUN_ROWS:
                yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                parts, rows = [], 0
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def byte_runs(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, start, value, length) of the runs of equal bytes of each row's binary: no shuffle, no window.

    Runs leave in small batches while a blob is read, so memory follows Spark's Arrow batches of the input alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([rows.schema[key], *StructType.fromDDL("start int, value int, length bigint").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, start, value, length in runs_of(x.as_buffer() or b"" for x in batch.column(1)):
                own = [pa.array(x.astype(t), f.type) for x, t, f in zip((start, value, length), (np.int32, np.int32, np.int64), list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(n)), *own], schema=arrow)

    return rows.select(key, content).mapInArrow(run, out)


def runs(stream: DataFrame, key: str = "blob_id", pos: str = "pos", value: str = "b") -> DataFrame:
    """(key, start, value, length): maximal runs of equal values, by gaps and islands."""
    w = Window.partitionBy(key).orderBy(pos)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = stream.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(key, "island").agg(F.min(pos).alias("start"), F.first(value).alias("value"), F.count(F.lit(1)).alias("length")).drop("island")
