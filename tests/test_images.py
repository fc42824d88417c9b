import pytest
from pyspark.sql import functions as F

from rasterloom.functions import codecs, images, tables
from rasterloom.functions.codecs.base import Frame, Raster, Sequence
from rasterloom.operators.policy import DecodePolicy
from rasterloom.plans.derive import raster_l8
from rasterloom.sources import raster as source


@pytest.fixture(scope="module")
def gray(spark, sf_dir):
    return images.raster_column(raster_l8(spark, sf_dir)).cache()


@pytest.mark.parametrize("fmt", ["PNG", "BMP", "GIF", "TIFF", "WEBP"])
def test_encode_then_decode_in_spark(gray, fmt):
    blobs = images.encode_images(gray, fmt)
    back = images.decode_images(blobs.select("image_id", "encoded"), "encoded").select("image_id", "ok", "value")
    rows = back.join(gray, "image_id").collect()
    assert rows and all(r.ok for r in rows)
    for r in rows:
        got = Raster(r.value.width, r.value.height, r.value.mode, bytes(r.value.pixels), bytes(r.value.palette_rgb) if r.value.palette_rgb else None)
        want = Raster(r.image.width, r.image.height, "L8", bytes(r.image.pixels))
        assert (got.rgba() == want.rgba()).all()


def test_rows_that_fail_keep_their_error(spark):
    good = codecs.encode(Raster(2, 2, "L8", b"\1\2\3\4"), "PNG")
    df = spark.createDataFrame([(1, good), (2, good[:20]), (3, b"nothing"), (4, None), (5, b"")], "id int, content binary")
    r = {x.id: x for x in images.decode_images(df).collect()}
    assert r[1].ok and not any(r[i].ok for i in (2, 3, 4, 5))
    assert r[2].error.kind == "Malformed" and r[2].error.format == "PNG" and r[3].error.kind == "UnknownFormat"
    assert {x.id: x.error for x in images.decode_images(df, prefix=True).collect()}[2].minimum == 33


def test_policy_order(spark):
    good = codecs.encode(Raster(20, 10, "L8", bytes(200)), "PNG")
    df = spark.createDataFrame([(good,)], "content binary")
    first = lambda p: images.decode_images(df, policy=p).first().error
    assert first(DecodePolicy(max_encoded_bytes=5, formats=())).resource == "EncodedBytes" or first(DecodePolicy(formats=())).reason == "PolicyDenied"
    assert first(DecodePolicy(formats=("GIF",), max_width=1)).reason == "PolicyDenied"
    e = first(DecodePolicy(max_width=30, max_height=9, max_pixels=1))
    assert (e.kind, e.resource, e.maximum, e.observed) == ("LimitExceeded", "Height", 9, 10)
    assert images.decode_images(df, policy=DecodePolicy(max_width=20, max_frames=1)).first().ok


def test_frames_and_sequences(spark):
    frames = [Frame(Raster(4, 4, "L8", bytes([i] * 16)), (0, 0, 4, 4), (i + 1, 10)) for i in range(3)]
    data = codecs.encode_sequence(Sequence(4, 4, frames, "TimedAnimation", "SourceRect", 0), "GIF")
    df = images.decode_frames(spark.createDataFrame([(7, data)], "image_id int, content binary"))
    assert [(r.value.frame_index, r.value.duration.num) for r in df.collect()] == [(0, 10), (1, 20), (2, 30)]
    again = images.encode_sequences(df, "WEBP").first()
    assert again.ok and len(codecs.decode_sequence(bytes(again.encoded))[1].value.frames) == 3


def test_table_functions(spark):
    tables.register(spark)
    df = spark.createDataFrame([(codecs.encode(Raster(2, 2, "L8", bytes(4)), "PNG"), codecs.encode(Raster(2, 2, "L8", bytes(4)), "TIFF"), b"x")], "png binary, tiff binary, bad binary")
    df.createOrReplaceTempView("blobs")
    assert [r.kind for r in spark.sql("SELECT c.kind FROM blobs, LATERAL png_chunks(png) c ORDER BY c.ordinal").collect()] == ["IHDR", "IDAT", "IEND"]
    assert spark.sql("SELECT first_value FROM blobs, LATERAL tiff_tags(tiff) t WHERE tag = 256").first()[0] == "2"
    assert spark.sql("SELECT * FROM blobs, LATERAL gif_frames(bad) g").count() == 0


def test_sink_and_scan(spark, tmp_path):
    source.register(spark)
    rows = [(f"i{n}.png", codecs.encode(Raster(n + 1, 1, "L8", bytes(n + 1)), "PNG")) for n in range(6)]
    df = spark.createDataFrame(rows, "name string, encoded binary").repartition(3)
    df.write.format("rasterloom").mode("append").option("path", str(tmp_path)).save()
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(n for n, _ in rows)
    with pytest.raises(Exception):  # noqa: B017
        df.write.format("rasterloom").mode("append").option("path", str(tmp_path)).save()
    read = source.read(spark, str(tmp_path))
    assert sorted(r.value.width for r in read.collect()) == [1, 2, 3, 4, 5, 6]
    few = source.scan(spark, str(tmp_path), DecodePolicy(max_encoded_bytes=10))
    assert few.count() == 0 and "LessThanOrEqual(length,10)" in few._jdf.queryExecution().executedPlan().toString()


def test_reassembly(spark, tmp_path):
    from rasterloom.streaming.prefix import reassemble

    blob = codecs.encode(Raster(5, 4, "L8", bytes(range(20))), "PNG")
    cut = [blob[i : i + 30] for i in range(0, len(blob), 30)]
    rows = [("a", i, p, i == len(cut) - 1) for i, p in enumerate(cut)][::-1] + [("b", 0, b"garbage that is long enough", True), ("c", 0, blob[:40], False)]
    spark.createDataFrame(rows, "blob_id string, seq int, piece binary, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("blob_id string, seq int, piece binary, last boolean").parquet(str(tmp_path / "in"))
    q = reassemble(stream).writeStream.format("memory").queryName("reassembled").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.blob_id: r for r in spark.table("reassembled").collect()}
    assert got["a"].status == "decoded" and (got["a"].width, got["a"].mode) == (5, "L8")
    assert got["b"].status == "failed" and "c" not in got


def test_columns_named_like_the_envelope_stay_usable(spark):
    df = spark.createDataFrame([(1, b"BM")], "id int, content binary").withColumn("path", F.lit("p"))
    assert images.inspect_images(df).columns[:2] == ["id", "path"]


def test_cancelled_jobs_end(spark):
    import threading
    import time

    from rasterloom.functions.control import controlled

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    with controlled(spark) as c:
        threading.Timer(3, c.cancel).start()
        began = time.time()
        with pytest.raises(Exception):  # noqa: B017
            spark.range(4).mapInArrow(slow, "id bigint").count()
        assert c.cancelled and time.time() - began < 50
    assert spark.range(3).count() == 3


def test_sql_functions(spark):
    from rasterloom.functions import udf

    udf.register(spark)
    good = codecs.encode(Raster(3, 2, "L8", bytes(range(6))), "PNG")
    spark.createDataFrame([(good,), (b"x",), (None,)], "content binary").createOrReplaceTempView("files")
    rows = spark.sql("SELECT image_inspect(content) AS i, image_pixels(content) AS p, image_metadata_bytes(content) AS m FROM files").collect()
    assert (rows[0].i.format, rows[0].i.width, bytes(rows[0].p)) == ("PNG", 3, bytes(range(6))) and rows[0].m == codecs.metadata_bytes(good)
    assert [r.i.error for r in rows[1:]] == ["UnknownFormat", "UnknownFormat"] and rows[1].p is None and rows[2].m is None
