"""Sequences, single frames, budgets, switched-off formats and PNG metadata."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import codecs, images
from rasterloom.functions.codecs import gif, png, tiff
from rasterloom.functions.codecs.base import Frame, Raster, Sequence
from rasterloom.functions.options import from_pairs
from rasterloom.operators.policy import DecodePolicy


def gray(n, v=0):
    return Raster(n, n, "L8", (np.arange(n * n) + v & 255).astype(np.uint8).tobytes())


def animation(**more):
    frames = [Frame(gray(8), (0, 0, 8, 8), (1, 10)), Frame(gray(8), (0, 0, 8, 8), (1, 4)), Frame(gray(8, 1), (0, 0, 8, 8), (1, 2))]
    return Sequence(8, 8, frames, "TimedAnimation", "Canvas", **more)


def test_gif_merges_equal_renders_and_cuts_to_what_changes():
    seq = animation(loops=3)
    seq.frames[2].image = Raster(8, 8, "L8", gray(8).pixels[:20] + b"\xff\xfe" + gray(8).pixels[22:])
    out = gif.decode_sequence(gif.encode_sequence(seq)).value
    assert [f.duration for f in out.frames] == [(35, 100), (50, 100)] and out.loops == 3
    assert out.frames[1].rect == (4, 2, 2, 1)
    shown = gif.renders(out)
    assert np.array_equal(shown[1][:, :, 0], np.frombuffer(seq.frames[2].image.pixels, np.uint8).reshape(8, 8))


def test_gif_renders_follow_disposal():
    red, dot = Raster(4, 4, "P8", bytes(16), b"\xff\0\0\0\xff\0"), Raster(2, 2, "P8", b"\0\1\1\0", b"\xff\0\0\0\xff\0", b"\0")
    frames = [Frame(red, (0, 0, 4, 4), (1, 10), 2), Frame(dot, (1, 1, 2, 2), (1, 10), 0), Frame(dot, (1, 1, 2, 2), (1, 10), 0)]
    seq = Sequence(4, 4, frames, "TimedAnimation", "SourceRect")
    one, two, three = gif.renders(seq)
    assert (one == [255, 0, 0, 255]).all() and two[:, :, 3].sum() == 2 * 255 and np.array_equal(two, three)
    assert (gif.renders(seq, disposal=0)[1][:, :, 3] == 255).all()
    assert len(gif.coalesce(seq)) == 2 and gif.coalesce(seq)[1].duration == (2, 10)


def test_gif_options():
    still = gif.decode_sequence(codecs.encode_sequence(animation(), "GIF", **from_pairs("GIF", [("animated", "false"), ("loop", "5")]))).value
    assert len(still.frames) == 1 and still.loops == 5
    data = codecs.encode_sequence(animation(), "GIF", **from_pairs("GIF", [("disposal", "background"), ("color_table", "global")]))
    out = gif.decode_sequence(data).value
    assert data[10] & 128 and [f.disposal for f in out.frames] == [2, 2]
    assert [f.image.pixels for f in out.frames][0] == gray(8).pixels


def test_one_page_and_basic_inspection(spark):
    pages = Sequence(8, 8, [Frame(gray(8, i), (0, 0, 8, 8)) for i in range(3)], "UntimedPages", "Page")
    data = tiff.encode_sequence(pages)
    r = codecs.decode_frame(data, 2)[1].value
    assert r.frames[0].image.pixels == gray(8, 2).pixels
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(gif.encode_sequence(animation())))], "id int, content binary")
    got = {r.id: r for r in images.decode_frames(rows, frame_index=1).collect()}
    assert got[1].value.frame_index == 1 and got[1].value.image.pixels == gray(8, 1).pixels and got[2].ok
    assert {r.id: r.ok for r in images.decode_frames(rows, frame_index=2).collect()} == {1: True, 2: False}
    basic = {r.id: r.value.frame_count for r in images.inspect_images(rows, count_frames=False).collect()}
    assert basic == {1: None, 2: 2}
    assert {r.error.reason for r in images.decode_images(rows, features=("PNG",)).collect()} == {"FeatureDisabled"}
    assert all(r.length_ok for r in images.check_lengths(images.decode_images(rows)).collect())
    short = spark.createDataFrame([(1, bytearray(data[:20]))], "id int, content binary")
    assert images.decode_frames(short, prefix=True).first().error.kind == "NeedMoreData" and images.decode_frames(short).first().error.kind == "Malformed"


def test_sequence_budget_in_the_decoder(spark):
    rows = spark.createDataFrame([(bytearray(gif.encode_sequence(animation())),)], "content binary")
    first = lambda **k: images.decode_frames(rows, policy=DecodePolicy(**k)).first()
    assert first(max_sequence_bytes=10_000, max_frame_bytes=64).ok
    e = first(max_sequence_bytes=100).error
    assert (e.resource, e.maximum, e.observed) == ("SequenceDecodedBytes", 100, 128)
    assert first(max_frame_bytes=63, max_sequence_bytes=100).error.resource == "FrameDecodedBytes"
    assert first(max_sequence_bytes=63).error.observed == 64


def test_lazy_images_remember_results_but_no_policy(spark):
    lazy = images.LazyImages(spark.createDataFrame([(bytearray(png.encode(gray(8))),)], "content binary"))
    assert not lazy.decoded(DecodePolicy(max_width=1)).first().ok and lazy.decoded().first().ok
    assert lazy.decoded() is lazy.decoded() and lazy.decoded().is_cached and lazy.decoded(DecodePolicy()) is not lazy.decoded()
    lazy.release()


def test_png_colour_chunks_and_compressed_metadata(spark):
    b, ck = png.encode(gray(8)), png._chunk
    icc = ck(b"iCCP", b"name\0\0" + zlib.compress(b"profile"))
    x = b[:33] + ck(b"sRGB", b"\7") + ck(b"sRGB", b"\1") + ck(b"sRGB", b"\1") + ck(b"gAMA", struct.pack(">I", 45455)) + icc + ck(b"cHRM", struct.pack(">8I", *range(8)))
    x += ck(b"zTXt", b"k\0\0bad") + ck(b"iTXt", b"k\0\1\0\0\0bad") + ck(b"zTXt", b"k\0\0" + zlib.compress(b"fine")) + ck(b"tEXt", b"k\0v") + b[33:]
    v = images.decode_images(spark.createDataFrame([(bytearray(x),)], "content binary")).first()
    c = v.value.color
    assert (c.srgb_intent, c.gamma, c.chromaticities, c.icc.keyword) == (1, 45455, list(range(8)), b"name")
    assert [m.kind for m in v.value.metadata] == [b"sRGB", b"sRGB", b"zTXt", b"tEXt"]
    assert [(d.kind, d.identity) for d in v.diagnostics] == [("InvalidMetadataIgnored", "png_zTXt"), ("InvalidMetadataIgnored", "png_iTXt")]
    with pytest.raises(codecs.CodecError, match="method"):
        codecs.decode(b[:33] + ck(b"zTXt", b"k\0\1" + zlib.compress(b"x")) + b[33:])


def test_sinks_write_all_or_nothing(spark, tmp_path):
    from rasterloom.sources import raster

    rows = spark.createDataFrame([("a", bytearray(gif.encode_sequence(animation()))), ("b", bytearray(gif.encode_sequence(animation(loops=2))))], "name string, content binary")
    frames = images.decode_frames(rows).where("ok").select("name", "value")
    raster.write_sequences(frames, "GIF", str(tmp_path / "seq"))
    out = raster.read(spark, str(tmp_path / "seq"), frames=True).collect()
    assert len(out) == 4 and all(r.ok for r in out)
    with pytest.raises(Exception, match="not encoded"):
        raster.write_sequences(frames, "GIF", str(tmp_path / "short"), policy_max_bytes=10)
    stills = frames.where("value.frame_index = 0").selectExpr("concat(name, '.png') as name", "value.image as image")
    raster.write_images(stills, "PNG", str(tmp_path / "png"))
    assert sorted(p.name for p in (tmp_path / "png").iterdir()) == ["a.png", "b.png"]
    assert all(r.ok for r in raster.read(spark, str(tmp_path / "png")).collect())
    with pytest.raises(Exception, match="not encoded"):
        raster.write_images(stills, "PNG", str(tmp_path / "bad"), compression=99)
    assert not [p for p in (tmp_path / "bad").glob("*.png")]


def test_png_ancillary_chunks():
    r = codecs.decode(png.encode(gray(8), **from_pairs("PNG", [(k, "yes") for k in ("time", "gamma", "srgb", "physical", "text_chunks")])))[1].value
    assert r.color == {"gamma": 45455, "srgb_intent": 0} and [k for k, _ in r.metadata] == [b"pHYs", b"tEXt", b"tIME"]


def test_udfs_turn_every_failure_into_a_row(spark, monkeypatch):
    from rasterloom.functions import udf

    rows = spark.createDataFrame([(bytearray(b"BM" + bytes(60)),), (None,), (bytearray(b"\xff\xd8\xff\xc0\0\2"),)], "content binary")
    assert [r.p for r in rows.select(udf.image_pixels("content").alias("p")).collect()] == [None] * 3
    assert all(r.x.error for r in rows.select(udf.image_inspect(F.coalesce("content", F.lit(b""))).alias("x")).collect())
