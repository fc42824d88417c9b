"""Queries over exploded samples and pixels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.operators import color, samples
from rasterloom.plans.derive import SQL_L8, SQL_RGB, raster_l8, raster_rgb
from rasterloom.plans.registry import query

_LAGS = SQL_L8 + """,
n AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS l, coalesce(lag(v) OVER (PARTITION BY image_id, x ORDER BY y), 0) AS u FROM l8),
p AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS ul FROM n),
q AS (SELECT *, CASE WHEN abs(u - ul) <= abs(l - ul) AND abs(u - ul) <= abs(l + u - 2 * ul) THEN l WHEN abs(l - ul) <= abs(l + u - 2 * ul) THEN u ELSE ul END AS pa FROM p),
r AS (SELECT image_id, y, (v + 256) % 256 AS none, (v - u + 256) % 256 AS up, (v - l + 256) % 256 AS sub, (v - ((l + u) >> 1) + 256) % 256 AS average, (v - pa + 256) % 256 AS paeth FROM q),
s AS (SELECT image_id, y, """ + ", ".join(f"CAST(sum(CASE WHEN {f} >= 128 THEN 256 - {f} ELSE {f} END) AS BIGINT) AS {f}" for f in ("none", "up", "sub", "average", "paeth")) + " FROM r GROUP BY image_id, y)"


def _filter_query(name: str) -> None:
    def run(spark, sf_dir):
        return samples.filter_scores(raster_l8(spark, sf_dir), (name,)).select("image_id", "y", F.col(name).alias("score"))

    query(f"WITH {_LAGS} SELECT image_id, y, {name} AS score FROM s", f"png_filter_{name}")(run)


for _f in ("none", "sub", "up", "average", "paeth"):
    _filter_query(_f)


def _select_sql(order: tuple[str, ...]) -> str:
    union = " UNION ALL ".join(f"SELECT image_id, y, '{f}' AS filter, {f} AS score, {i} AS i FROM s" for i, f in enumerate(order))
    return f"WITH {_LAGS}, c AS ({union}) SELECT image_id, y, filter, score FROM c QUALIFY row_number() OVER (PARTITION BY image_id, y ORDER BY score, i) = 1"


@query(_select_sql(("none", "up", "sub", "paeth")))
def png_filter_select(spark, sf_dir):
    return samples.select_filter(raster_l8(spark, sf_dir))


@query(_select_sql(("none", "up", "sub", "average", "paeth")))
def png_filter_select_optimize(spark, sf_dir):
    return samples.select_filter(raster_l8(spark, sf_dir), optimize=True)


@query(f"WITH {SQL_L8} SELECT image_id, v, count(*) AS n FROM l8 GROUP BY image_id, v")
def raster_histogram(spark, sf_dir):
    return raster_l8(spark, sf_dir).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_L8} SELECT image_id, count(DISTINCT v) AS n_levels, min(v) AS low, max(v) AS high FROM l8 GROUP BY image_id")
def distinct_samples(spark, sf_dir):
    return raster_l8(spark, sf_dir).groupBy("image_id").agg(F.count_distinct("v").alias("n_levels"), F.min("v").alias("low"), F.max("v").alias("high"))


@query(f"WITH {SQL_L8}, d AS (SELECT DISTINCT image_id, v FROM l8) SELECT image_id, v, CAST(row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS INTEGER) AS idx FROM d")
def gray_palette_compact(spark, sf_dir):
    used = raster_l8(spark, sf_dir).select("image_id", "v").distinct()
    return used.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("v")) - 1)


@query(f"""WITH {SQL_RGB}, d AS (SELECT DISTINCT image_id, r, g, b FROM rgb), i AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS idx FROM d)
SELECT image_id, bool_and(r = idx AND g = idx AND b = idx) AS identity_gray, CAST(max(idx) + 1 AS INTEGER) AS entries FROM i GROUP BY image_id""")
def identity_gray_palette(spark, sf_dir):
    colors = raster_rgb(spark, sf_dir).select("image_id", "r", "g", "b").distinct()
    rows = colors.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("r", "g", "b")) - 1)
    return rows.groupBy("image_id").agg(F.expr("bool_and(r = idx and g = idx and b = idx)").alias("identity_gray"), (F.max("idx") + 1).alias("entries"))


@query(f"WITH {SQL_L8} SELECT image_id, y, x, (v - coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), 0) + 256) % 256 AS d FROM l8")
def tiff_predictor_apply(spark, sf_dir):
    return samples.predictor_apply(raster_l8(spark, sf_dir)).select("image_id", "y", "x", "d")


@query(f"WITH {SQL_L8} SELECT image_id, y, x, v AS restored FROM l8")
def tiff_predictor_reverse(spark, sf_dir):
    return samples.predictor_reverse(samples.predictor_apply(raster_l8(spark, sf_dir))).select("image_id", "y", "x", "restored")


@query(f"WITH {SQL_L8} SELECT image_id, y, x, 255 - v AS v FROM l8")
def tiff_min_is_white(spark, sf_dir):
    return raster_l8(spark, sf_dir).select("image_id", "y", "x", (255 - F.col("v")).alias("v"))


@query(f"WITH {SQL_L8} SELECT image_id, y, CAST(x // 8 AS INTEGER) AS byte_no, CAST(sum(CASE WHEN v >= 128 THEN 1 << (7 - x % 8) ELSE 0 END) AS BIGINT) AS byte FROM l8 GROUP BY image_id, y, x // 8")
def bit_pack_l1(spark, sf_dir):
    out = samples.pack_bits(raster_l8(spark, sf_dir), F.when(F.col("v") >= 128, 1).otherwise(0))
    return out.withColumn("byte_no", F.col("byte_no").cast("int"))


@query(f"WITH {SQL_L8} SELECT image_id, y, CAST(x * 8 + k AS INTEGER) AS x, CAST((v >> (7 - k)) & 1 AS INTEGER) AS bit FROM l8, range(0, 8) t(k)")
def bit_unpack_l1(spark, sf_dir):
    bits = F.array(*(samples.unpack_index("v", k, 1) for k in range(8)))
    rows = raster_l8(spark, sf_dir).select("image_id", "y", "x", F.posexplode(bits).alias("k", "bit"))
    return rows.select("image_id", "y", (F.col("x") * 8 + F.col("k")).alias("x"), "bit")


@query(f"WITH {SQL_L8} SELECT image_id, y, CAST(x * 2 + k AS INTEGER) AS x, CAST((v >> (4 - 4 * k)) & 15 AS INTEGER) AS idx FROM l8, range(0, 2) t(k)")
def index_unpack_4bit(spark, sf_dir):
    halves = F.array(*(samples.unpack_index("v", k, 4) for k in range(2)))
    rows = raster_l8(spark, sf_dir).select("image_id", "y", "x", F.posexplode(halves).alias("k", "idx"))
    return rows.select("image_id", "y", (F.col("x") * 2 + F.col("k")).alias("x"), "idx")


@query(f"WITH {SQL_L8} SELECT image_id, y, x, CAST((v & 3) * 255 // 3 AS INTEGER) AS v2, CAST((v & 15) * 255 // 15 AS INTEGER) AS v4 FROM l8")
def png_gray_scale(spark, sf_dir):
    v = F.col("v")
    return raster_l8(spark, sf_dir).select("image_id", "y", "x", samples.scale_to_byte(v.bitwiseAND(3), 2).alias("v2"), samples.scale_to_byte(v.bitwiseAND(15), 4).alias("v4"))


@query(f"WITH {SQL_L8}, w AS (SELECT image_id, y, x // 2 AS x, max(v) FILTER (WHERE x % 2 = 0) AS hi, max(v) FILTER (WHERE x % 2 = 1) AS lo FROM l8 GROUP BY image_id, y, x // 2) SELECT image_id, y, CAST(x AS INTEGER) AS x, hi * 256 + lo AS v16, hi AS v8, lpad(hex(lo), 2, '0') || lpad(hex(hi), 2, '0') AS le_hex FROM w")
def png_16bit_transfer(spark, sf_dir):
    """Two bytes, high first, as a 16-bit sample: its value, its 8-bit cut and its little-endian transfer bytes."""
    pair = raster_l8(spark, sf_dir).groupBy("image_id", "y", F.expr("cast(x div 2 as int)").alias("x")).agg(F.max(F.when(F.col("x") % 2 == 0, F.col("v"))).alias("hi"), F.max(F.when(F.col("x") % 2 == 1, F.col("v"))).alias("lo"))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    return pair.select("image_id", "y", "x", (F.col("hi") * 256 + F.col("lo")).alias("v16"), F.col("hi").alias("v8"), F.concat(two("lo"), two("hi")).alias("le_hex"))


_PASS = "CASE " + " ".join(f"WHEN x >= {a} AND y >= {b} AND (x - {a}) % {c} = 0 AND (y - {b}) % {d} = 0 THEN {i}" for i, (a, b, c, d) in enumerate(samples.ADAM7, 1)) + " END"


@query(f"WITH {SQL_L8}, p AS (SELECT *, {_PASS} AS pass FROM l8) SELECT image_id, pass, count(*) AS pixels, count(DISTINCT x) AS width, count(DISTINCT y) AS height, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY image_id, pass")
def adam7_scatter(spark, sf_dir):
    rows = raster_l8(spark, sf_dir).withColumn("pass", samples.adam7_pass(F.col("x"), F.col("y")))
    return rows.groupBy("image_id", "pass").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("x").alias("width"), F.count_distinct("y").alias("height"), F.sum("v").alias("total"))


@query(f"WITH {SQL_L8}, r AS (SELECT DISTINCT image_id, y, CASE WHEN y % 8 = 0 THEN 0 WHEN y % 8 = 4 THEN 1 WHEN y % 4 = 2 THEN 2 ELSE 3 END AS pass FROM l8) SELECT image_id, y, pass, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pass, y) - 1 AS INTEGER) AS stored_row FROM r")
def gif_interlace_order(spark, sf_dir):
    rows = raster_l8(spark, sf_dir).select("image_id", "y").distinct().withColumn("pass", samples.gif_pass(F.col("y")))
    return rows.withColumn("stored_row", F.row_number().over(Window.partitionBy("image_id").orderBy("pass", "y")) - 1)


@query(f"WITH {SQL_L8} SELECT image_id, CAST(y // 16 AS INTEGER) AS tile_y, CAST(x // 16 AS INTEGER) AS tile_x, CAST((y % 16) * 16 + x % 16 AS INTEGER) AS offset_in_tile, v FROM l8")
def tiff_tile_placement(spark, sf_dir):
    return raster_l8(spark, sf_dir).select("image_id", F.expr("cast(y div 16 as int)").alias("tile_y"), F.expr("cast(x div 16 as int)").alias("tile_x"), F.expr("(y % 16) * 16 + x % 16").alias("offset_in_tile"), "v")


_YCC = "(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS yy, (-11059 * r - 21709 * g + 32768 * b + 8421375) >> 16 AS cb, (32768 * r - 27439 * g - 5329 * b + 8421375) >> 16 AS cr"


@query(f"WITH {SQL_RGB} SELECT image_id, y, x, {_YCC} FROM rgb")
def rgb_to_ycbcr(spark, sf_dir):
    yy, cb, cr = color.rgb_to_ycbcr(*(F.col(c) for c in "rgb"))
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", yy.alias("yy"), cb.alias("cb"), cr.alias("cr"))


@query(f"""WITH {SQL_RGB} SELECT image_id, y, x, CAST(least(greatest(r + ((91881 * (b - 128) + 32768) >> 16), 0), 255) AS INTEGER) AS r2,
CAST(least(greatest(r + ((-22554 * (g - 128) - 46802 * (b - 128) + 32768) >> 16), 0), 255) AS INTEGER) AS g2, CAST(least(greatest(r + ((116130 * (g - 128) + 32768) >> 16), 0), 255) AS INTEGER) AS b2 FROM rgb""")
def ycbcr_to_rgb(spark, sf_dir):
    """The pixel's bytes taken as Y, Cb, Cr."""
    out = color.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", *(c.alias(n) for c, n in zip(out, ("r2", "g2", "b2"), strict=True)))


@query(f"WITH {SQL_RGB} SELECT image_id, y, x, " + ", ".join(f"CAST(((255 - {c}) * (255 - x * 12) + 127) // 255 AS INTEGER) AS {c}2" for c in "rgb") + " FROM rgb")
def cmyk_to_rgb(spark, sf_dir):
    """The pixel's bytes taken as C, M, Y, with K = 12 x."""
    out = color.cmyk_to_rgb(F.col("r"), F.col("g"), F.col("b"), F.col("x") * 12)
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", *(c.alias(n) for c, n in zip(out, ("r2", "g2", "b2"), strict=True)))


@query(f"WITH {SQL_RGB} SELECT image_id, y, x, (r + g) % 256 AS r2, (b + g) % 256 AS b2 FROM rgb")
def subtract_green(spark, sf_dir):
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", ((F.col("r") + F.col("g")) % 256).alias("r2"), ((F.col("b") + F.col("g")) % 256).alias("b2"))


_I8 = "(CASE WHEN {0} >= 128 THEN {0} - 256 ELSE {0} END)"


@query(f"""WITH {SQL_RGB}, s AS (SELECT image_id, y, x, g, b, (r + ((-17 * {_I8.format('g')}) >> 5) + 2560) % 256 AS r2 FROM rgb)
SELECT image_id, y, x, r2, (b + ((30 * {_I8.format('g')}) >> 5) + ((-90 * {_I8.format('r2')}) >> 5) + 2560) % 256 AS b2 FROM s""")
def cross_color_inverse(spark, sf_dir):
    r2, b2 = color.undo_cross_color(F.col("r"), F.col("g"), F.col("b"), 239, 30, 166)
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", r2.alias("r2"), b2.alias("b2"))


@query(f"WITH {SQL_RGB} SELECT image_id, y, x, (16839 * r + 33059 * g + 6420 * b + 32768 + 1048576) >> 16 AS luma FROM rgb")
def webp_rgb_to_y(spark, sf_dir):
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", color.webp_luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


@query(f"""WITH {SQL_RGB}, s AS (SELECT image_id, y // 2 AS y, x // 2 AS x, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM rgb GROUP BY image_id, y // 2, x // 2 HAVING count(*) = 4)
SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(least(greatest(CAST(-9719 * r - 19081 * g + 28800 * b + 33685504 AS BIGINT) >> 18, 0), 255) AS INTEGER) AS u,
CAST(least(greatest(CAST(28800 * r - 24116 * g - 4684 * b + 33685504 AS BIGINT) >> 18, 0), 255) AS INTEGER) AS v FROM s""")
def webp_rgb_to_uv(spark, sf_dir):
    quad = raster_rgb(spark, sf_dir).groupBy("image_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"))
    rows = quad.agg(*(F.sum(c).alias(c) for c in "rgb"), F.count(F.lit(1)).alias("n")).where("n = 4")
    u, v = color.webp_chroma(F.col("r"), F.col("g"), F.col("b"))
    return rows.select("image_id", "y", "x", u.alias("u"), v.alias("v"))


@query(f"""WITH {SQL_RGB}, s AS (SELECT *, (r * 257 * 16320) >> 16 AS lv FROM rgb) SELECT image_id, y, x, CAST(least(greatest((lv + 90 * b - 11488) >> 6, 0), 255) AS INTEGER) AS r2,
CAST(least(greatest((lv + 8736 - (22 * g + 46 * b)) >> 6, 0), 255) AS INTEGER) AS g2, CAST(least(greatest((lv + 113 * g - 14432) >> 6, 0), 255) AS INTEGER) AS b2 FROM s""")
def avif_yuv_to_rgb(spark, sf_dir):
    out = color.bt601_full_range(F.col("r"), F.col("g"), F.col("b"))
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", *(c.alias(n) for c, n in zip(out, ("r2", "g2", "b2"), strict=True)))


@query(f"WITH {SQL_RGB}, t AS (SELECT *, g * (255 - x * 12) + r * x * 12 + 128 AS t FROM rgb) SELECT image_id, y, x, (t + (t >> 8)) >> 8 AS blended FROM t")
def alpha_blend_png(spark, sf_dir):
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", color.blend_byte(F.col("r"), F.col("g"), F.col("x") * 12).alias("blended"))


@query(f"""WITH {SQL_RGB}, a AS (SELECT *, x * 12 AS sa FROM rgb), f AS (SELECT *, (b * (256 - sa)) >> 8 AS f FROM a), s AS (SELECT *, sa + f AS al FROM f)
SELECT image_id, y, x, CAST(CASE WHEN sa = 0 THEN g WHEN b = 0 OR sa = 255 THEN r ELSE ((CAST(r * sa + g * f AS BIGINT) * (16777216 // al)) % 4294967296) >> 24 END AS INTEGER) AS ch,
CAST(CASE WHEN sa = 0 THEN b WHEN b = 0 THEN sa WHEN sa = 255 THEN 255 ELSE al END AS INTEGER) AS alpha FROM s""")
def alpha_blend_webp(spark, sf_dir):
    ch, alpha = color.blend_unmultiplied(F.col("r"), F.col("x") * 12, F.col("g"), F.col("b"))
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", ch.alias("ch"), alpha.alias("alpha"))


def _rgb565(p: str) -> str:
    return f"CAST((({p} >> 11) & 31) * 255 // 31 AS INTEGER) AS r5, CAST((({p} >> 5) & 63) * 255 // 63 AS INTEGER) AS g6, CAST(({p} & 31) * 255 // 31 AS INTEGER) AS b5"


@query(f"WITH {SQL_RGB} SELECT image_id, y, x, {_rgb565('(r * 256 + g)')}, (r * 256 + g) >> 4 AS wide FROM rgb")
def bmp_bitfield_extract(spark, sf_dir):
    p = F.col("r") * 256 + F.col("g")
    out = [color.bitfield(p, m).alias(n) for m, n in ((0xF800, "r5"), (0x07E0, "g6"), (0x001F, "b5"))]
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", *out, F.shiftright(p, 4).alias("wide"))


@query(f"WITH {SQL_L8}, e AS (SELECT image_id, y, x // 2 AS x, sum(v) AS s FROM l8 GROUP BY image_id, y, x // 2) SELECT image_id, y, CAST(x AS INTEGER) AS x, CAST((CAST(s AS BIGINT) + x % 2) >> 1 AS INTEGER) AS c FROM e")
def chroma_downsample_h2v1(spark, sf_dir):
    rows = raster_l8(spark, sf_dir).groupBy("image_id", "y", F.expr("cast(x div 2 as int)").alias("x")).agg(F.sum("v").alias("s"))
    return rows.select("image_id", "y", "x", F.shiftright(F.col("s") + F.col("x") % 2, 1).cast("int").alias("c"))


@query(f"""WITH {SQL_L8}, h AS (SELECT image_id, max(y) AS h FROM l8 GROUP BY image_id), pad AS (SELECT image_id, y, x, v FROM l8 UNION ALL SELECT l8.image_id, y + 1, x, v FROM l8 JOIN h USING (image_id) WHERE y = h AND h % 2 = 0),
e AS (SELECT image_id, y // 2 AS y, x // 2 AS x, sum(v) AS s FROM pad GROUP BY image_id, y // 2, x // 2) SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((CAST(s AS BIGINT) + 1 + x % 2) >> 2 AS INTEGER) AS c FROM e""")
def chroma_downsample_h2v2(spark, sf_dir):
    """An odd last row is replicated: its quads have two samples, counted twice."""
    quad = raster_l8(spark, sf_dir).groupBy("image_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"))
    rows = quad.agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("s", F.when(F.col("n") == 2, F.col("s") * 2).otherwise(F.col("s")))
    return rows.select("image_id", "y", "x", F.shiftright(F.col("s") + 1 + F.col("x") % 2, 2).cast("int").alias("c"))


@query(f"""WITH {SQL_L8}, n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM l8 WINDOW w AS (PARTITION BY image_id, y ORDER BY x))
SELECT image_id, y, CAST(2 * x + k AS INTEGER) AS x, CAST(CASE WHEN k = 0 THEN CASE WHEN l IS NULL THEN v ELSE (3 * v + l + 1) >> 2 END ELSE CASE WHEN r IS NULL THEN v ELSE (3 * v + r + 2) >> 2 END END AS INTEGER) AS c FROM n, range(0, 2) t(k)""")
def chroma_upsample_h2v1(spark, sf_dir):
    v, left, right = F.col("v"), F.lag("v").over(samples.in_row()), F.lead("v").over(samples.in_row())
    pair = F.array(F.coalesce(F.shiftright(3 * v + left + 1, 2), v), F.coalesce(F.shiftright(3 * v + right + 2, 2), v))
    rows = raster_l8(spark, sf_dir).select("image_id", "y", "x", pair.alias("p"))
    return rows.select("image_id", "y", "x", F.posexplode("p").alias("k", "c")).select("image_id", "y", (2 * F.col("x") + F.col("k")).alias("x"), "c")


@query(f"WITH {SQL_RGB} SELECT image_id, r, g, b, count(*) AS n FROM rgb GROUP BY ALL")
def rgb_distinct_palette(spark, sf_dir):
    return raster_rgb(spark, sf_dir).groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_RGB}, pal AS (SELECT CAST(i AS INTEGER) AS idx, CAST((i // 9) * 120 AS INTEGER) AS pr, CAST((i // 3 % 3) * 120 AS INTEGER) AS pg, CAST((i % 3) * 120 AS INTEGER) AS pb FROM range(0, 27) t(i)),
d AS (SELECT image_id, y, x, idx, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS dist FROM rgb, pal)
SELECT image_id, y, x, idx, dist FROM d QUALIFY row_number() OVER (PARTITION BY image_id, y, x ORDER BY dist, idx) = 1""")
def nearest_palette(spark, sf_dir):
    """Nearest of a fixed palette, ties to the lowest index: an arg-min over a literal array, so no rows are multiplied."""
    palette = [(i, i // 9 * 120, i // 3 % 3 * 120, i % 3 * 120) for i in range(27)]
    r, g, b = (F.col(c) for c in "rgb")
    best = F.array_min(F.array(*(F.struct(((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)).alias("dist"), F.lit(i).alias("idx")) for i, pr, pg, pb in palette)))
    return raster_rgb(spark, sf_dir).select("image_id", "y", "x", best.alias("m")).select("image_id", "y", "x", "m.idx", "m.dist")


@query(f"WITH {SQL_L8}, s AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id, v ORDER BY y, x) AS k FROM l8) SELECT image_id, CAST(sum((v - 128) * (v - 128)) AS BIGINT) AS sse FROM s GROUP BY image_id")
def squared_error(spark, sf_dir):
    """Squared error of each image against mid-gray."""
    e = F.col("v") - 128
    return raster_l8(spark, sf_dir).groupBy("image_id").agg(F.sum(e * e).alias("sse"))
