"""Queries over blocks of transform coefficients: 64 numbers of an embedding make an 8 x 8 block, 16 a 4 x 4 one."""

from pyspark.sql import functions as F

from rasterloom.functions import images
from rasterloom.functions.codecs.jpeg import TRANSFORM, quant_table
from rasterloom.operators import jpegmath, vp8math
from rasterloom.plans.derive import SQL_L8, raster_l8, table
from rasterloom.plans.registry import query

_M = TRANSFORM.ravel().tolist()
_SQL_M = f"m AS (SELECT [{', '.join(map(str, _M))}] AS m)"
#: Coefficients between -512 and 511 from numbers between -1 and 1.
_SQL_BLOCKS = "b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 512) AS BIGINT)) AS c FROM embeddings)"


def _blocks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 512).cast("bigint")).alias("c"))


def _sql_pass(values: str, bits: int, rows: bool, transposed: bool) -> str:
    out = "i % 8" if rows else "i // 8"
    at = "(i // 8) * 8 + k" if rows else "k * 8 + i % 8"
    place = f"k * 8 + {out}" if transposed else f"({out}) * 8 + k"
    return f"[CAST(floor((list_sum([m[{place} + 1] * {values}[{at} + 1] for k in range(0, 8)]) + {1 << (bits - 1)}) / {1 << bits}.0) AS BIGINT) for i in range(0, 64)]"


@query(f"WITH {_SQL_M}, {_SQL_BLOCKS}, p AS (SELECT vec_id, m, {_sql_pass('c', 11, False, False)} AS w FROM b, m), s AS (SELECT vec_id, {_sql_pass('w', 18, True, False)} AS s FROM p) SELECT vec_id, array_to_string([least(greatest(x + 128, 0), 255) for x in s], ',') AS samples FROM s")
def jpeg_inverse_dct(spark, sf_dir):
    return _blocks(spark, sf_dir).select("vec_id", F.array_join(jpegmath.inverse_dct(F.col("c"), _M).cast("array<string>"), ",").alias("samples"))


@query(f"WITH {_SQL_M}, {_SQL_BLOCKS}, a AS (SELECT vec_id, [x // 4 for x in [least(greatest(y + 512, 0), 1023) for y in c]] AS x FROM b), d AS (SELECT vec_id, [y - 128 for y in x] AS x FROM a), p AS (SELECT vec_id, m, {_sql_pass('x', 11, True, True)} AS w FROM d, m) SELECT vec_id, array_to_string({_sql_pass('w', 15, False, True)}, ',') AS coefficients FROM p")
def jpeg_forward_dct(spark, sf_dir):
    samples = F.transform("c", lambda x: F.floor(F.least(F.greatest(x + 512, F.lit(0)), F.lit(1023)) / 4).cast("bigint"))
    return _blocks(spark, sf_dir).select("vec_id", F.array_join(jpegmath.forward_dct(samples, _M).cast("array<string>"), ",").alias("coefficients"))


_STEPS = quant_table(jpegmath.LUMINANCE, 95).tolist()


@query(f"""WITH {_SQL_M}, q AS (SELECT [{', '.join(map(str, _STEPS))}] AS q), {SQL_L8},
size AS (SELECT image_id, max(y) + 1 AS h FROM l8 GROUP BY image_id),
pad AS (SELECT s.image_id, p.y, l8.x, l8.v FROM size s, LATERAL (SELECT unnest(range(0, CAST((s.h + 7) // 8 * 8 AS BIGINT))) AS y) p JOIN l8 ON l8.image_id = s.image_id AND l8.y = least(p.y, s.h - 1)),
b AS (SELECT image_id, y // 8 AS r, x // 8 AS k, list(CAST(v AS BIGINT) - 128 ORDER BY y, x) AS x FROM pad GROUP BY ALL),
f1 AS (SELECT image_id, r, k, m, {_sql_pass('x', 11, True, True)} AS w FROM b, m), f2 AS (SELECT image_id, r, k, m, {_sql_pass('w', 15, False, True)} AS c FROM f1),
l AS (SELECT image_id, r, k, m, [sign(c[i]) * ((abs(c[i]) + 4 * q[i]) // (8 * q[i])) * q[i] for i in range(1, 65)] AS c FROM f2, q),
i1 AS (SELECT image_id, r, k, m, {_sql_pass('c', 11, False, False)} AS w FROM l), i2 AS (SELECT image_id, r, k, {_sql_pass('w', 18, True, False)} AS s FROM i1),
px AS (SELECT image_id, 8 * r + i // 8 AS y, 8 * k + i % 8 AS x, least(greatest(s[i + 1] + 128, 0), 255) AS v FROM i2, range(0, 64) t(i)),
rows AS (SELECT px.image_id, y, string_agg(lpad(hex(CAST(v AS BIGINT)), 2, '0'), '' ORDER BY x) AS row FROM px JOIN size ON size.image_id = px.image_id AND px.y < size.h GROUP BY px.image_id, y)
SELECT image_id, sha256(from_hex(string_agg(row, '' ORDER BY y))) AS pixels_sha256 FROM rows GROUP BY image_id""")
def roundtrip_jpeg(spark, sf_dir):
    """Gray images coded at quality 95 and decoded: what transform, quantisation and inverse make of them, to the byte."""
    blobs = images.encode_images(images.raster_column(raster_l8(spark, sf_dir)), "JPEG", quality=95).select("image_id", "encoded")
    return images.decode_images(blobs, "encoded").select("image_id", F.sha2("value.pixels", 256).alias("pixels_sha256"))


def _sql_four(c: str, at: str, step: int) -> str:
    """Four outputs of one VP8 inverse transform pass over elements at, at + step, ... of c."""
    e = lambda k: f"{c}[{at} + {k * step} + 1]"
    sin, cos = (lambda v: f"CAST(floor({v} * 35468 / 65536.0) AS BIGINT)"), (lambda v: f"({v} + CAST(floor({v} * 20091 / 65536.0) AS BIGINT))")
    a, b, cc, d = f"({e(0)} + {e(2)})", f"({e(0)} - {e(2)})", f"({sin(e(1))} - {cos(e(3))})", f"({cos(e(1))} + {sin(e(3))})"
    return f"[{a} + {d}, {b} + {cc}, {b} - {cc}, {a} - {d}]"


def _sql_wht(c: str, at: str, step: int) -> str:
    e = lambda k: f"{c}[{at} + {k * step} + 1]"
    a, b, cc, d = f"({e(0)} + {e(3)})", f"({e(1)} + {e(2)})", f"({e(1)} - {e(2)})", f"({e(0)} - {e(3)})"
    return f"[{a} + {b}, {cc} + {d}, {a} - {b}, {d} - {cc}]"


def _sql_two(four, bias: int) -> str:
    """Columns first, then rows, then a shift by 3 with a bias."""
    return f"""v AS (SELECT vec_id, flatten([{four('c', 'x', 4)} for x in range(0, 4)]) AS t FROM b),
h AS (SELECT vec_id, flatten([{four('t', 'y', 4)} for y in range(0, 4)]) AS o FROM v)
SELECT vec_id, array_to_string([CAST(floor((x + {bias}) / 8.0) AS BIGINT) for x in o], ',') AS residual FROM h"""


@query(f"WITH {_SQL_BLOCKS}, {_sql_two(_sql_four, 4)}")
def vp8_inverse_dct(spark, sf_dir):
    return _blocks(spark, sf_dir).select("vec_id", F.array_join(vp8math.inverse_dct(F.col("c")).cast("array<string>"), ",").alias("residual"))


@query(f"WITH {_SQL_BLOCKS}, {_sql_two(_sql_wht, 3)}")
def vp8_inverse_wht(spark, sf_dir):
    return _blocks(spark, sf_dir).select("vec_id", F.array_join(vp8math.inverse_wht(F.col("c")).cast("array<string>"), ",").alias("residual"))


_SQL_EDGE = """px AS (SELECT vec_id, i, [least(greatest(CAST(floor((CAST(embedding[8 * i + k] AS DOUBLE) + 1) * 127.5) AS INTEGER), 0), 255) for k in range(1, 9)] AS p FROM embeddings, range(0, 8) t(i))"""


@query(f"""WITH {_SQL_EDGE}, d AS (SELECT vec_id, i, p[3] AS p1, p[4] AS p0, p[5] AS q0, p[6] AS q1 FROM px),
c AS (SELECT *, abs(p0 - q0) * 2 + abs(p1 - q1) // 2 <= 60 AS go, least(greatest(least(greatest(p1 - q1, -128), 127) + 3 * (q0 - p0), -128), 127) AS a FROM d),
f AS (SELECT *, CAST(floor(least(a + 4, 127) / 8.0) AS INTEGER) AS f1, CAST(floor(least(a + 3, 127) / 8.0) AS INTEGER) AS f2 FROM c)
SELECT vec_id, CAST(i AS INTEGER) AS edge, CASE WHEN go THEN least(greatest(p0 + f2, 0), 255) ELSE p0 END AS p0, CASE WHEN go THEN least(greatest(q0 - f1, 0), 255) ELSE q0 END AS q0 FROM f""")
def vp8_simple_filter(spark, sf_dir):
    """Eight samples across each edge, under a limit of 60."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5).cast("int"), F.lit(0)), F.lit(255))).alias("e"))
    rows = e.select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("edge"))
    p1, p0, q0, q1 = (F.get("e", F.col("edge") * 8 + k) for k in (2, 3, 4, 5))
    a, b = vp8math.simple_filter(p1, p0, q0, q1, 60)
    return rows.select("vec_id", "edge", a.alias("p0"), b.alias("q0"))


@query(f"""WITH {_SQL_EDGE}, s AS (SELECT vec_id, i, p[1] AS n, p[2] AS f, p[3] AS nu, p[4] AS fu FROM px)
SELECT vec_id, CAST(i AS INTEGER) AS cell, (9 * n + 3 * f + 3 * nu + fu + 8) // 16 AS u, least(greatest((((19077 * p[5]) // 256) + ((26149 * p[6]) // 256) - 14234) // 64, 0), 255) AS r FROM s JOIN px USING (vec_id, i)""")
def vp8_upsample_yuv(spark, sf_dir):
    """A chroma sample between four, and red of a luma and a chroma sample."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5).cast("int"), F.lit(0)), F.lit(255))).alias("e"))
    rows = e.select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cell"))
    at = [F.get("e", F.col("cell") * 8 + k) for k in range(6)]
    return rows.select("vec_id", "cell", vp8math.fancy(*at[:4]).alias("u"), vp8math.yuv_to_rgb(at[4], F.lit(0), at[5])[0].alias("r"))
