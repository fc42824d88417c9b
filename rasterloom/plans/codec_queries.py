"""Queries on checksums, compression framing and JPEG kernels."""

from pyspark.sql import functions as F

from rasterloom.operators import checksum, jpegmath, samples
from rasterloom.plans.derive import SQL_BYTES, SQL_L8, raster_l8, table, text_blobs
from rasterloom.plans.registry import query


@query(f"""WITH {SQL_BYTES}, n AS (SELECT blob_id, count(*) AS n FROM bytes GROUP BY blob_id) SELECT blob_id, n.n AS n_bytes, CAST(((n.n + sum((n.n - pos) * b)) % 65521) * 65536 + (1 + sum(b)) % 65521 AS BIGINT) AS adler FROM bytes JOIN n USING (blob_id) GROUP BY blob_id, n.n""")
def adler32_text(spark, sf_dir):
    n = F.col("n")
    return checksum.byte_sums(text_blobs(spark, sf_dir), "blob_id", "content").select("blob_id", n.alias("n_bytes"), checksum.adler32(F.col("total"), F.col("weighted"), n).alias("adler"))


@query()
def crc32_text(spark, sf_dir):
    """SQL would take a step for each byte of the longest text; tests/test_whole_texts.py holds it against zlib."""
    return text_blobs(spark, sf_dir).select("blob_id", F.crc32("content").alias("crc"))


@query("SELECT doc_id, CAST(2 + 5 * greatest(ceil(strlen(text) / 65535.0), 1) + strlen(text) + 4 AS BIGINT) AS stored FROM documents")
def zlib_stored_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checksum.zlib_stored_length(F.octet_length("text")).alias("stored"))


@query("""WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h, strlen(p_name) AS n FROM part),
s AS (SELECT *, list_transform(range(0, n), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM h),
t AS (SELECT *, (1 + list_sum(b)) % 65521 AS x, (n + list_sum(list_transform(range(0, n), lambda i: (n - i) * b[i + 1]))) % 65521 AS y FROM s),
k AS (SELECT *, list_transform(range(0, (n + 9) // 10), lambda i: least(n - 10 * i, 10)) AS sizes FROM t)
SELECT p_partkey, '7801' || array_to_string(list_transform(range(0, len(sizes)), lambda i: CASE WHEN i + 1 = len(sizes) THEN '01' ELSE '00' END || lpad(hex(sizes[i + 1]), 2, '0') || '00' || lpad(hex(255 - sizes[i + 1]), 2, '0') || 'FF' || h[20 * i + 1:20 * i + 2 * sizes[i + 1]]), '')
  || lpad(hex(CAST(y * 65536 + x AS BIGINT)), 8, '0') AS stream FROM k""")
def zlib_stored_stream(spark, sf_dir):
    """Names in stored blocks of ten bytes."""
    return table(spark, sf_dir, "part").select("p_partkey", checksum.zlib_stored(F.hex(F.encode("p_name", "UTF-8")), 10).alias("stream"))


@query("WITH r AS (SELECT p_partkey, (p_size * 3 + 1) * (p_partkey % 97 + 1) AS raw FROM part) SELECT p_partkey, CAST(8 + 25 + 12 + 2 + 5 * greatest(ceil(raw / 65535.0), 1) + raw + 4 + 12 AS BIGINT) AS png_bytes FROM r")
def png_output_len_level0(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", checksum.png_output_length(F.col("p_size"), F.col("p_partkey") % 97 + 1, 3).cast("bigint").alias("png_bytes"))


_PASSES = "p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b}, {c}, {d})" for i, (a, b, c, d) in enumerate(samples.ADAM7, 1)) + ") t(pass, x0, y0, dx, dy))"


@query(f"WITH {_PASSES}, g AS (SELECT p_partkey, pass, greatest((p_size - x0 + dx - 1) // dx, 0) AS w, greatest((p_partkey % 97 + 1 - y0 + dy - 1) // dy, 0) AS h FROM part, p) SELECT p_partkey, pass, CAST(w AS BIGINT) AS pass_width, CAST(h AS BIGINT) AS pass_height, CAST(CASE WHEN w > 0 THEN h * (1 + (w * 4 + 7) // 8) ELSE 0 END AS BIGINT) AS filtered_bytes FROM g")
def adam7_pass_geometry(spark, sf_dir):
    """Size of each interlace pass and its filtered bytes at four bits a pixel."""
    passes = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((i, *p), ("pass", "x0", "y0", "dx", "dy"), strict=True))) for i, p in enumerate(samples.ADAM7, 1)))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 97 + 1).alias("h"), F.explode(passes).alias("p")).select("p_partkey", "p_size", "h", "p.*")
    side = lambda n, at, step: F.greatest(F.floor((F.col(n) - F.col(at) + F.col(step) - 1) / F.col(step)), F.lit(0)).cast("bigint")
    w, h = side("p_size", "x0", "dx"), side("h", "y0", "dy")
    return rows.select("p_partkey", "pass", w.alias("pass_width"), h.alias("pass_height"), F.when(w > 0, h * (1 + F.floor((w * 4 + 7) / 8))).otherwise(0).cast("bigint").alias("filtered_bytes"))


@query(f"WITH {_PASSES} SELECT p_partkey, CAST(sum(CASE WHEN p_size > x0 AND p_partkey % 97 + 1 > y0 THEN ((p_partkey % 97 + 1 - y0 + dy - 1) // dy) * (1 + ((p_size - x0 + dx - 1) // dx) * 3) ELSE 0 END) AS BIGINT) AS interlaced, CAST(any_value((p_size * 3 + 1) * (p_partkey % 97 + 1)) AS BIGINT) AS plain FROM part, p GROUP BY p_partkey")
def png_inflated_len(spark, sf_dir):
    w, h = F.col("p_size"), F.col("p_partkey") % 97 + 1
    total = F.lit(0)
    for x0, y0, dx, dy in samples.ADAM7:
        total = total + F.when((w > x0) & (h > y0), F.floor((h - y0 + dy - 1) / dy) * (1 + F.floor((w - x0 + dx - 1) / dx) * 3)).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", total.cast("bigint").alias("interlaced"), ((w * 3 + 1) * h).cast("bigint").alias("plain"))


@query(f"""WITH {SQL_BYTES}, m AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY blob_id ORDER BY pos) = b THEN 0 ELSE 1 END AS new FROM bytes), r AS (SELECT *, sum(new) OVER (PARTITION BY blob_id ORDER BY pos) AS island FROM m)
SELECT blob_id, min(pos) AS start, any_value(b) AS value, count(*) AS length FROM r GROUP BY blob_id, island""")
def packbits_runs(spark, sf_dir):
    return samples.byte_runs(text_blobs(spark, sf_dir), "blob_id", "content")


_Z = "z AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {n})" for i, n in enumerate(jpegmath.zigzag())) + ") t(position, place))"
_T = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(jpegmath.LUMINANCE, jpegmath.CHROMINANCE, strict=True))) + ") t(place, luma, chroma))"


@query("WITH c AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM range(0, 8) a(r), range(0, 8) b(c)) SELECT CAST(row_number() OVER (ORDER BY r + c, CASE WHEN (r + c) % 2 = 1 THEN r ELSE c END) - 1 AS INTEGER) AS position, 8 * r + c AS place FROM c")
def jpeg_zigzag(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(jpegmath.zigzag())), "position int, place int")


@query(f"WITH {_T}, q AS (SELECT CAST(q AS INTEGER) AS quality, CAST(CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS INTEGER) AS s FROM range(1, 101) t(q)) SELECT quality, place, CAST(least(greatest((luma * s + 50) // 100, 1), 255) AS INTEGER) AS luma, CAST(least(greatest((chroma * s + 50) // 100, 1), 255) AS INTEGER) AS chroma FROM q, t")
def jpeg_quant_table(spark, sf_dir):
    base = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("luma"), F.lit(b).alias("chroma")) for i, (a, b) in enumerate(zip(jpegmath.LUMINANCE, jpegmath.CHROMINANCE, strict=True))))
    rows = spark.range(1, 101).select(F.col("id").cast("int").alias("quality"), F.explode(base).alias("t")).select("quality", "t.*")
    q = F.col("quality")
    return rows.select("quality", "place", jpegmath.scaled_quant(F.col("luma"), q).alias("luma"), jpegmath.scaled_quant(F.col("chroma"), q).alias("chroma"))


@query(f"WITH {SQL_L8}, {_T}, c AS (SELECT image_id, y, x, (v - 128) * 8 AS v, luma AS d FROM l8 JOIN t ON t.place = (y % 8) * 8 + x % 8) SELECT image_id, y, x, CAST(CASE WHEN v < 0 THEN -((-v + (d >> 1)) // d) ELSE (v + (d >> 1)) // d END AS INTEGER) AS level FROM c")
def jpeg_quantize(spark, sf_dir):
    """Samples as coefficients, quantised by the luminance table (a literal array, looked up by place)."""
    divisor = F.get(F.array(*(F.lit(x) for x in jpegmath.LUMINANCE)), (F.col("y") % 8) * 8 + F.col("x") % 8)
    return raster_l8(spark, sf_dir).select("image_id", "y", "x", jpegmath.quantize((F.col("v") - 128) * 8, divisor).alias("level"))


_DC = SQL_L8 + ", d AS (SELECT image_id, y, CAST(x // 8 AS INTEGER) AS blk, CAST(sum(v) - 1024 AS BIGINT) AS dc FROM l8 GROUP BY image_id, y, x // 8), f AS (SELECT *, dc - coalesce(lag(dc) OVER (PARTITION BY image_id, y ORDER BY blk), 0) AS diff FROM d)"
_NBITS = "CASE WHEN diff = 0 THEN 0 ELSE length(bin(abs(diff))) END"


def _dc(spark, sf_dir):
    rows = raster_l8(spark, sf_dir).groupBy("image_id", "y", F.expr("cast(x div 8 as int)").alias("blk")).agg((F.sum("v") - 1024).alias("dc"))
    return jpegmath.dc_differences(rows, ("image_id", "y"), "blk", "dc")


@query(f"WITH {_DC} SELECT image_id, y, blk, diff, CAST({_NBITS} AS INTEGER) AS nbits, CAST((CASE WHEN diff < 0 THEN diff - 1 ELSE diff END) & ((1::BIGINT << ({_NBITS})) - 1) AS BIGINT) AS bits FROM f")
def jpeg_dc_diff_category(spark, sf_dir):
    """Eight samples of a row as a block, a row as a restart segment."""
    d = F.col("diff")
    return _dc(spark, sf_dir).select("image_id", "y", "blk", "diff", jpegmath.bit_category(d).alias("nbits"), jpegmath.magnitude_bits(d).alias("bits"))


@query(f"WITH {_DC} SELECT image_id, CAST({_NBITS} AS INTEGER) AS symbol, count(*) AS n FROM f GROUP BY ALL")
def jpeg_huffman_freq(spark, sf_dir):
    return _dc(spark, sf_dir).select("image_id", jpegmath.bit_category(F.col("diff")).alias("symbol")).groupBy("image_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT CAST(label AS INTEGER) AS image_id, CAST(k AS INTEGER) AS symbol, CAST(4 + (k * 7 + label) % 9 AS INTEGER) AS len FROM (SELECT DISTINCT label FROM embeddings), range(0, 16) t(k))
SELECT image_id, symbol, len, CAST(coalesce(sum(1::BIGINT << (16 - len)) OVER (PARTITION BY image_id ORDER BY len, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // (1::BIGINT << (16 - len)) AS code FROM s""")
def canonical_huffman_codes(spark, sf_dir):
    k = F.col("symbol")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id")).distinct().withColumn("symbol", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return jpegmath.canonical_codes(rows.withColumn("len", 4 + (k * 7 + F.col("image_id")) % 9), ("image_id",), "symbol", "len").select("image_id", "symbol", "len", "code")
