"""Frame sequences (sequence_id, frame_index, ...): durations, coalescing, budgets, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def in_sequence() -> WindowSpec:
    return Window.partitionBy("sequence_id").orderBy("frame_index")


def so_far() -> WindowSpec:
    return in_sequence().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def milliseconds(num: Column, den: Column) -> Column:
    """num / den seconds in whole milliseconds, halves to even, in integers alone."""
    n = num.cast("bigint") * 1000
    q, r = F.floor(n / den).cast("bigint"), n % den
    return q + F.when((2 * r > den) | ((2 * r == den) & (q % 2 == 1)), 1).otherwise(0)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive integers below 2**31, by Euclid's steps."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["a"])


def add_durations(n1: Column, d1: Column, n2: Column, d2: Column) -> tuple[Column, Column]:
    """Sum of two rationals over their least common denominator; the numerator isn't reduced."""
    g = gcd(d1, d2)
    left, right = F.floor(d2 / g).cast("bigint"), F.floor(d1 / g).cast("bigint")
    return n1 * left + n2 * right, d1 * left


def lcm(a: Column, b: Column) -> Column:
    return F.floor(a / gcd(a, b)).cast("bigint") * b


def coalesce_renders(frames: DataFrame) -> DataFrame:
    """Runs of frames with equal renders: first frame, frames, and the sum of durations as a rational.

    Adding rationals one by one over their least common denominators ends at the least common multiple of all
    denominators; numerators are summed for each distinct denominator first, so a long run is never collected."""
    same = F.lag("render").over(in_sequence()).eqNullSafe(F.col("render")) & (F.row_number().over(in_sequence()) > 1)
    marked = frames.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(so_far()))
    parts = marked.groupBy("sequence_id", "run", "den").agg(F.min("frame_index").alias("first_frame"), F.count(F.lit(1)).alias("frames"), F.sum("num").alias("num"))
    runs = parts.groupBy("sequence_id", "run").agg(F.min("first_frame").alias("first_frame"), F.sum("frames").alias("frames"), F.collect_list(F.struct(F.col("den").cast("bigint").alias("den"), "num")).alias("parts"))
    runs = runs.withColumn("den", F.aggregate("parts.den", F.lit(1).cast("bigint"), lcm))
    num = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["num"] * F.floor(F.col("den") / p["den"]).cast("bigint"))
    return runs.select("sequence_id", "run", "first_frame", "frames", num.alias("num"), "den")


def gif_delay(num: Column, den: Column) -> Column:
    """Centiseconds, where they are exact and fit 16 bits; else null."""
    exact = (num * 100) % den == 0
    cs = F.floor(num * 100 / den).cast("bigint")
    return F.when(exact & (cs <= 65535), cs)


def budget_violation(frames: DataFrame, frame_max: int, total_max: int) -> DataFrame:
    """(sequence_id, frame_index, resource, observed): the first frame over a limit. The primary frame is charged
    first; a later frame meets its own limit before the sum's."""
    size = F.col("width") * F.col("height") * 4
    rows = frames.withColumn("size", size).withColumn("total", F.sum("size").over(so_far()))
    own = (F.col("frame_index") > 0) & (F.col("size") > frame_max)
    resource = F.when(own, "FrameDecodedBytes").when(F.col("total") > total_max, "SequenceDecodedBytes")
    bad = rows.withColumn("resource", resource).where("resource IS NOT NULL")
    first = bad.groupBy("sequence_id").agg(F.min(F.struct("frame_index", "resource", F.when(own, F.col("size")).otherwise(F.col("total")).alias("observed"))).alias("f"))
    return first.select("sequence_id", "f.*")


def validate_sequence(frames: DataFrame, canvas_w: int, canvas_h: int, layout: str = "Canvas") -> DataFrame:
    """(sequence_id, valid, first_bad, reason): origins of 0 or more, positive sizes, rectangles inside the canvas,
    positive denominators, and, where frames are whole canvases, rasters of its size (image_width, image_height)."""
    reason = (
        F.when((F.col("left") < 0) | (F.col("top") < 0), "negative origin")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "empty frame")
        .when((F.col("left") + F.col("width") > canvas_w) | (F.col("top") + F.col("height") > canvas_h), "rectangle outside canvas")
        .when(F.col("den") == 0, "zero denominator")
    )
    if {"image_width", "image_height"} <= set(frames.columns):
        wanted = (F.lit(canvas_w), F.lit(canvas_h)) if layout == "Canvas" else (F.col("width"), F.col("height"))
        reason = reason.when((F.col("image_width") != wanted[0]) | (F.col("image_height") != wanted[1]), "raster of another size")
    rows = frames.withColumn("reason", reason)
    bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("frame_index", "reason"))).alias("f")
    return rows.groupBy("sequence_id").agg(bad).select("sequence_id", F.col("f").isNull().alias("valid"), F.col("f.frame_index").alias("first_bad"), F.col("f.reason").alias("reason"))


def plain_still(frames: DataFrame) -> DataFrame:
    """Sequences that a still encoder may take: one frame, the whole canvas, without duration, disposal, blend,
    interlacing, default image, loop count or background. codecs.plain_still is the same rule on objects."""
    facts = (
        "left = 0 and top = 0 and width = canvas_width and height = canvas_height and coalesce(num, 0) = 0 and coalesce(disposal, 0) = 0 "
        "and blend is null and not interlaced and not default_image and loop_count is null and background is null"
    )
    one = F.count(F.lit(1)) == 1
    return frames.groupBy("sequence_id").agg((one & F.expr(f"bool_and({facts})")).alias("plain_still"))
