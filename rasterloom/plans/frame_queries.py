"""Queries over frame sequences."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.operators import frames as ops
from rasterloom.plans.derive import SQL_FRAMES, SQL_L8, frames, raster_l8, table
from rasterloom.plans.registry import query


@query(f"WITH {SQL_FRAMES} SELECT sequence_id, frame_index, 1000 * num // den + CASE WHEN 2 * (1000 * num % den) > den OR (2 * (1000 * num % den) = den AND (1000 * num // den) % 2 = 1) THEN 1 ELSE 0 END AS ms FROM frames")
def frame_duration_ms_round(spark, sf_dir):
    return frames(spark, sf_dir).select("sequence_id", "frame_index", ops.milliseconds(F.col("num"), F.col("den")).alias("ms"))


@query(f"""WITH {SQL_FRAMES}, n AS (SELECT *, lead(num) OVER w AS n2, lead(den) OVER w AS d2 FROM frames WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index))
SELECT sequence_id, frame_index, num * (d2 // gcd(den, d2)) + n2 * (den // gcd(den, d2)) AS num, den * (d2 // gcd(den, d2)) AS den FROM n WHERE n2 IS NOT NULL""")
def frame_duration_lcm_add(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("n2", F.lead("num").over(ops.in_sequence())).withColumn("d2", F.lead("den").over(ops.in_sequence())).where("n2 IS NOT NULL")
    n, d = ops.add_durations(F.col("num"), F.col("den"), F.col("n2"), F.col("d2"))
    return rows.select("sequence_id", "frame_index", n.alias("num"), d.alias("den"))


@query(f"""WITH {SQL_FRAMES}, m AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 1000 ELSE 60 END AS d, CASE WHEN lag(render) OVER (PARTITION BY sequence_id ORDER BY frame_index) = render THEN 0 ELSE 1 END AS new FROM frames),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS BIGINT) AS run FROM m),
l AS (SELECT sequence_id, run, list_reduce(list(CAST(d AS BIGINT)), lambda a, b: lcm(a, b)) AS den FROM r GROUP BY ALL)
SELECT r.sequence_id, r.run, min(frame_index) AS first_frame, count(*) AS frames, CAST(sum(num * (den.den // d)) AS BIGINT) AS num, den.den AS den
FROM r JOIN l den ON den.sequence_id = r.sequence_id AND den.run = r.run GROUP BY r.sequence_id, r.run, den.den""")
def gif_frame_coalesce(spark, sf_dir):
    """Durations with denominators 7, 1000 and 60, whose sums no fixed tick holds."""
    den = F.expr("case event_id % 3 when 0 then 7 when 1 then 1000 else 60 end")
    return ops.coalesce_renders(frames(spark, sf_dir).withColumn("den", den))


@query(f"""WITH {SQL_L8}, p AS (SELECT a.image_id, CAST(a.y // 16 AS INTEGER) AS frame_index, a.y % 16 AS y, a.x, a.v > 127 AS px FROM l8 a),
d AS (SELECT c.image_id, c.frame_index, c.x, c.y FROM p c JOIN p b ON b.image_id = c.image_id AND b.frame_index = c.frame_index - 1 AND b.y = c.y AND b.x = c.x WHERE b.px <> c.px)
SELECT image_id, frame_index, min(x) AS "left", CAST(min(y) AS INTEGER) AS top, max(x) - min(x) + 1 AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height FROM d GROUP BY image_id, frame_index""")
def frame_diff_bbox(spark, sf_dir):
    """16-row strips of an image as frames: the box that holds what changed since the frame before."""
    p = raster_l8(spark, sf_dir).select("image_id", F.expr("cast(y div 16 as int)").alias("frame_index"), (F.col("y") % 16).alias("y"), "x", (F.col("v") > 127).alias("px"))
    before = F.lag("px").over(Window.partitionBy("image_id", "y", "x").orderBy("frame_index"))
    d = p.withColumn("b", before).where("b <> px")
    return d.groupBy("image_id", "frame_index").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


@query(f"WITH {SQL_FRAMES} SELECT sequence_id, frame_index, CASE WHEN num * 100 % den = 0 AND num * 100 // den <= 65535 THEN num * 100 // den END AS delay FROM frames")
def gif_delay_check(spark, sf_dir):
    return frames(spark, sf_dir).select("sequence_id", "frame_index", ops.gif_delay(F.col("num"), F.col("den")).alias("delay"))


@query(f"WITH {SQL_FRAMES} SELECT sequence_id, frame_index, coalesce(CASE WHEN event_id % 3 = 0 THEN 2 END, CASE disposal WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) AS code FROM frames")
def gif_disposal_effective(spark, sf_dir):
    override = F.when(F.col("event_id") % 3 == 0, 2)
    return frames(spark, sf_dir).select("sequence_id", "frame_index", F.coalesce(override, F.col("disposal")).alias("code"))


@query(f"""WITH {SQL_FRAMES}, s AS (SELECT *, width * height * 4 AS size FROM frames), t AS (SELECT *, CAST(sum(size) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS BIGINT) AS total FROM s),
b AS (SELECT sequence_id, frame_index, CASE WHEN frame_index > 0 AND size > 1200 THEN 'FrameDecodedBytes' WHEN total > 4000 THEN 'SequenceDecodedBytes' END AS resource, CASE WHEN frame_index > 0 AND size > 1200 THEN size ELSE total END AS observed FROM t)
SELECT * FROM b WHERE resource IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) = 1""")
def sequence_budget_first_violation(spark, sf_dir):
    return ops.budget_violation(frames(spark, sf_dir), 1200, 4000)


@query(f"""WITH {SQL_FRAMES}, g AS (SELECT *, "left" - 1 AS x, CASE WHEN event_id % 23 = 0 THEN 0 ELSE den END AS d, CASE WHEN event_id % 29 = 0 THEN 0 ELSE width END AS w, width + CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS iw FROM frames),
r AS (SELECT *, CASE WHEN x < 0 OR top < 0 THEN 'negative origin' WHEN w <= 0 OR height <= 0 THEN 'empty frame' WHEN x + w > 24 OR top + height > 28 THEN 'rectangle outside canvas'
  WHEN d = 0 THEN 'zero denominator' WHEN iw <> w THEN 'raster of another size' END AS reason FROM g)
SELECT sequence_id, count(reason) = 0 AS valid, min(frame_index) FILTER (WHERE reason IS NOT NULL) AS first_bad, arg_min(reason, frame_index) FILTER (WHERE reason IS NOT NULL) AS reason FROM r GROUP BY sequence_id""")
def sequence_validate(spark, sf_dir):
    odd = frames(spark, sf_dir).withColumn("left", F.col("left") - 1).withColumn("den", F.expr("if(event_id % 23 = 0, 0, den)")).withColumn("image_width", F.expr("width + if(event_id % 31 = 0, 1, 0)")).withColumn("width", F.expr("if(event_id % 29 = 0, 0, width)"))
    return ops.validate_sequence(odd.withColumn("image_height", F.col("height")), 24, 28, layout="Rectangle")


@query("""SELECT event_id // (1 + event_id // 4 % 2) AS sequence_id, count(*) = 1 AND bool_and(event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0
  AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0) AS plain_still FROM events GROUP BY 1""")
def plain_still_semantics(spark, sf_dir):
    """Sequences of one or two events, each fact of an animation present in every so many."""
    often = lambda n, v: f"if(event_id % {n} = 0, {v})"
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id div (1 + event_id div 4 % 2) as sequence_id", "40 as canvas_width", "30 as canvas_height", "if(event_id % 11 = 0, 1, 0) as left", "if(event_id % 13 = 0, 2, 0) as top",
        "if(event_id % 17 = 0, 39, 40) as width", "if(event_id % 7 = 0, 29, 30) as height", "if(event_id % 5 = 0, 3, 0) as num", "if(event_id % 3 = 0, 2, 0) as disposal",
        often(19, "'Over'").replace(")", ", null)") + " as blend", "event_id % 23 = 0 as interlaced", "event_id % 29 = 0 as default_image",
        often(31, "0").replace(")", ", null)") + " as loop_count", often(37, "5").replace(")", ", null)") + " as background",
    )
    return ops.plain_still(e)


@query(f"WITH {SQL_FRAMES}, s AS (SELECT sequence_id, event_id, event_id - min(event_id) OVER (PARTITION BY sequence_id) AS seq, row_number() OVER (PARTITION BY sequence_id ORDER BY event_id) - 1 AS expected FROM frames) SELECT sequence_id, bool_and(seq = expected) AS in_order, min(event_id) FILTER (WHERE seq <> expected) AS first_wrong FROM s GROUP BY sequence_id")
def apng_sequence_numbers(spark, sf_dir):
    """Control numbers must count up by one."""
    w = Window.partitionBy("sequence_id")
    s = frames(spark, sf_dir).select("sequence_id", "event_id", (F.col("event_id") - F.min("event_id").over(w)).alias("seq"), (F.row_number().over(w.orderBy("event_id")) - 1).alias("expected"))
    return s.groupBy("sequence_id").agg(F.expr("bool_and(seq = expected)").alias("in_order"), F.min(F.when(F.col("seq") != F.col("expected"), F.col("event_id"))).alias("first_wrong"))


@query(f"WITH {SQL_FRAMES} SELECT sequence_id, CASE WHEN count(*) > 1 OR sequence_id % 2 = 0 OR sequence_id % 3 = 0 THEN '89a' ELSE '87a' END AS version, CAST(greatest(max(\"left\" + width), 20) AS BIGINT) AS canvas_width, CAST(greatest(max(top + height), 20) AS BIGINT) AS canvas_height, count(*) = 1 AND max(width) >= 16 AND max(height) >= 16 AS interlaced FROM frames GROUP BY sequence_id")
def gif_stream_header(spark, sf_dir):
    """Version (an even number: looped; a multiple of three: transparent), canvas over a 20 x 20 screen, default interlace."""
    many = (F.count(F.lit(1)) > 1) | (F.col("sequence_id") % 2 == 0) | (F.col("sequence_id") % 3 == 0)
    g = frames(spark, sf_dir).groupBy("sequence_id")
    side = lambda a, b: F.greatest(F.max(F.col(a) + F.col(b)), F.lit(20)).cast("bigint")
    interlaced = (F.count(F.lit(1)) == 1) & (F.max("width") >= 16) & (F.max("height") >= 16)
    return g.agg(F.when(many, "89a").otherwise("87a").alias("version"), side("left", "width").alias("canvas_width"), side("top", "height").alias("canvas_height"), interlaced.alias("interlaced"))


@query(f"""WITH {SQL_FRAMES}, n AS (SELECT sequence_id, frame_index, render, lag(render) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS before FROM frames) SELECT sequence_id, frame_index, CASE WHEN render = before THEN 'transparent' ELSE render END AS masked FROM n""")
def gif_mask_unchanged(spark, sf_dir):
    """What equals the frame before becomes transparent."""
    same = F.lag("render").over(ops.in_sequence()) == F.col("render")
    return frames(spark, sf_dir).select("sequence_id", "frame_index", F.when(same, "transparent").otherwise(F.col("render")).alias("masked"))
