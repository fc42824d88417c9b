import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.functions import codecs
from rasterloom.functions.codecs import avif, bmp, gif, ico, jpeg, png, tiff, webp
from rasterloom.functions.codecs.base import BYTES, CodecError, Frame, Raster, Sequence


def raster(mode, w, h, seed=0):
    rng = np.random.default_rng(seed)
    if mode == "L1":
        return Raster(w, h, mode, np.packbits(rng.integers(0, 2, (h, w), dtype=np.uint8), axis=1).tobytes())
    y, x = np.mgrid[:h, :w]
    a = (np.stack([3 * x + y * (i + 1) + rng.integers(0, 9, (h, w)) for i in range(BYTES[mode])], -1) % 256).astype(np.uint8)
    if mode == "P8":
        return Raster(w, h, mode, (a[:, :, 0] % 40).tobytes(), rng.integers(0, 256, 120, dtype=np.uint8).tobytes())
    return Raster(w, h, mode, a.tobytes())


def same(a, b):
    return (a.width, a.height, a.mode, a.pixels) == (b.width, b.height, b.mode, b.pixels)


sizes = st.tuples(st.integers(1, 40), st.integers(1, 40), st.integers(0, 9))


@settings(max_examples=25, deadline=None)
@given(sizes, st.sampled_from(sorted(png.COLOR_OF)), st.booleans(), st.integers(0, 9))
def test_png_round_trip(size, mode, optimize, level):
    i = raster(mode, *size)
    data = png.encode(i, level, optimize)
    assert same(png.decode(data).value, i) and codecs.inspect(data)[1].mode == mode
    assert codecs.verify(data) == "PNG"


@settings(max_examples=25, deadline=None)
@given(sizes, st.sampled_from(["L1", "P8", "L8", "Rgb8"]))
def test_bmp_round_trip(size, mode):
    i = raster(mode, *size)
    data = bmp.encode(i)
    assert same(bmp.decode(data).value, i) and bmp.metadata_bytes(data) == struct.unpack_from("<I", data, 10)[0]


@settings(max_examples=25, deadline=None)
@given(sizes, st.sampled_from(sorted(tiff.PHOTO)), st.sampled_from(sorted(tiff.METHODS)), st.booleans())
def test_tiff_round_trip(size, mode, method, predictor):
    i = raster(mode, *size)
    assert same(tiff.decode(tiff.encode(i, method, predictor)).value, i)


@settings(max_examples=25, deadline=None)
@given(sizes, st.sampled_from(["L1", "L8", "P8", "Rgb8"]), st.sampled_from([None, True, False]))
def test_gif_keeps_up_to_256_colours(size, mode, interlace):
    i = raster(mode, *size)
    got = gif.decode(gif.encode(i, interlace)).value
    if len(np.unique(i.rgba().reshape(-1, 4), axis=0)) <= 256:
        assert np.array_equal(got.rgba()[:, :, :3], i.rgba()[:, :, :3])


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 3))
def test_code_streams(data, times):
    data = data * (times + 1)
    assert gif.lzw_decode(gif.lzw_encode(data, 8), 8, len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


@settings(max_examples=20, deadline=None)
@given(sizes, st.sampled_from(["L1", "P8", "L8", "L16", "La8", "Rgb8", "Rgba8", "Cmyk8"]))
def test_webp_lossless_round_trip(size, mode):
    i = raster(mode, *size)
    assert np.array_equal(webp.decode(webp.encode(i)).value.rgba(), i.rgba())


@pytest.mark.parametrize("mode", ["L1", "L8", "Rgb8", "Cmyk8"])
@pytest.mark.parametrize("sub", ["4:4:4", "4:2:2", "4:2:0"])
@pytest.mark.parametrize("optimize", [False, True])
def test_jpeg_round_trip(mode, sub, optimize):
    y, x = np.mgrid[:37, :29]
    n = 1 if mode in ("L1", "L8") else BYTES[mode]
    smooth = np.stack([(128 + 90 * np.sin(x / 9 + i) * np.cos(y / 11)) for i in range(n)], -1).astype(np.uint8)
    i = Raster(29, 37, mode, np.packbits(np.ones((37, 29), np.uint8), axis=1).tobytes() if mode == "L1" else smooth.tobytes())
    got = jpeg.decode(jpeg.encode(i, 92, sub, optimize, restart_rows=1)).value
    assert got.mode == ("L8" if mode == "L1" else mode)
    assert np.abs(got.array().astype(int) - i.array().astype(int)).mean() < 6


def test_ico_best_entry_and_both_kinds():
    i = raster("Rgba8", 16, 12)
    for kind in ("png", "bmp"):
        assert np.array_equal(ico.decode(ico.encode(i, kind)).value.rgba(), i.rgba())
    assert ico.best([(16, 16, 0), (0, 0, 1), (0, 0, 2)])[2] == 1


def test_apng_composites():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def control(n, w, h, x, y, dispose, blend):
        return chunk(b"fcTL", struct.pack(">IIIIIHHBB", n, w, h, x, y, 1, 10, dispose, blend))

    pixel = lambda *v: zlib.compress(b"\0" + bytes(v))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 6, 0, 0, 0)) + chunk(b"acTL", struct.pack(">II", 2, 3))
    data += control(0, 2, 1, 0, 0, 0, 0) + chunk(b"IDAT", pixel(10, 20, 30, 255, 40, 50, 60, 255))
    data += control(1, 1, 1, 1, 0, 0, 1) + chunk(b"fdAT", struct.pack(">I", 2) + pixel(200, 200, 200, 128)) + chunk(b"IEND", b"")
    s = png.decode_sequence(data).value
    assert s.loops == 3 and [f.duration for f in s.frames] == [(1, 10), (1, 10)]
    t = [b * (255 - 128) + 200 * 128 + 128 for b in (40, 50, 60)]
    assert list(s.frames[1].image.pixels[4:7]) == [(v + (v >> 8)) >> 8 for v in t]
    assert list(s.frames[1].image.pixels[:4]) == [10, 20, 30, 255]


def test_png_crc_rules():
    data = bytearray(png.encode(raster("L8", 4, 4)))
    at = data.index(b"IDAT")
    n = struct.unpack_from(">I", data, at - 4)[0]
    data[at + 4 + n] ^= 1
    r = codecs.decode(bytes(data))[1]
    assert [d[3] for d in r.diagnostics] == ["png_IDAT_crc"]
    with pytest.raises(CodecError):
        codecs.verify(bytes(data))


def test_gif_sequence_and_trailing_bytes():
    frames = [Frame(raster("P8", 8, 8, s), (0, 0, 8, 8), (1, 10)) for s in (0, 0, 1)]
    data = gif.encode_sequence(Sequence(8, 8, frames, "TimedAnimation", "SourceRect", 2))
    r = codecs.decode_sequence(data + b"xx")[1]
    assert [f.duration for f in r.value.frames] == [(20, 100), (10, 100)] and r.value.loops == 2
    assert r.diagnostics[-1] == ("TrailingDataIgnored", "SequenceDecode", len(data), "trailing_input")


def test_bmp_runs_and_bit_fields():
    head = struct.pack("<IIIIiiHHIIiiII", 0, 0, 54 + 8, 40, 4, 2, 1, 8, 1, 0, 0, 0, 2, 0)
    data = b"BM" + head + bytes([0, 0, 0, 0, 255, 255, 255, 0]) + bytes([4, 1, 0, 0, 0, 3, 0, 1, 0, 0, 1, 1, 0, 1])
    assert list(bmp.decode(data).value.pixels) == [0, 1, 0, 1, 1, 1, 1, 1]
    assert bmp.extract(np.array([0b0111110000000000], np.uint32), 0x7C00)[0] == 255


def test_avif_items():
    def box(kind, body):
        return struct.pack(">I", 8 + len(body)) + kind + body

    ispe = box(b"ispe", bytes(4) + struct.pack(">II", 30, 20))
    ipma = box(b"ipma", bytes(4) + struct.pack(">IHBB", 1, 1, 1, 0x81))
    meta = bytes(4) + box(b"pitm", bytes(4) + b"\0\1") + box(b"iprp", box(b"ipco", ispe) + ipma)
    data = box(b"ftyp", b"avif" + bytes(4)) + box(b"meta", meta)
    fmt, info = codecs.inspect(data)
    assert (fmt, info.width, info.height) == ("AVIF", 30, 20) and avif.items(data)[0].associations == [(1, 1, True)]
    with pytest.raises(CodecError) as e:
        codecs.decode(data)
    assert (e.value.kind, e.value.reason) == ("Unsupported", "NotImplemented")


@settings(max_examples=120, deadline=None, derandomize=True)
@given(st.sampled_from(["JPEG", "PNG", "GIF", "BMP", "WEBP", "TIFF", "ICO"]), st.integers(0, 400), st.binary(min_size=1, max_size=6), st.booleans())
def test_damaged_data_fails_with_a_typed_error(fmt, at, noise, cut):
    data = codecs.encode(raster("Rgb8", 9, 7), fmt)
    at %= len(data)
    data = data[:at] if cut else data[:at] + noise + data[at + len(noise) :]
    for f in (codecs.inspect, codecs.decode, codecs.decode_sequence, codecs.verify):
        try:
            f(data)
        except CodecError:
            pass


@settings(max_examples=15, deadline=None)
@given(sizes, st.sampled_from(["L8", "Rgb8"]), st.sampled_from(["4:4:4", "4:2:2", "4:2:0"]), st.sampled_from([5, 60, 95]))
def test_progressive_jpeg_holds_the_baseline_coefficients(size, mode, sub, quality):
    i = raster(mode, *size)
    a, b = (jpeg.decode(jpeg.encode(i, quality, sub, progressive=p)).value for p in (False, True))
    assert a.pixels == b.pixels


def test_option_pairs():
    from rasterloom.functions.options import from_pairs

    assert from_pairs("JPEG", [("quality", "90"), ("subsampling", "420"), ("progressive", "Yes")]) == {"quality": 90, "subsampling": "4:2:0", "progressive": True}
    assert from_pairs("PNG", [("compression", "max"), ("gamma", "off"), ("interlace", "on")]) == {"compression": 9, "gamma": False}
    for fmt, pairs, text in (
        ("PNG", [("zzz", "1"), ("optimize", "1"), ("optimize", "1")], "duplicate"),
        ("BMP", [("quality", "1")], "unknown"),
        ("JPEG", [("quality", "x")], "numeric"),
        ("PNG", [("optimize", "maybe")], "boolean"),
        ("JPEG", [("exif_hex", "abc")], "hex"),
        ("ICO", [("sizes", "16x16,32x32")], "pair"),
    ):
        with pytest.raises(CodecError, match=text):
            from_pairs(fmt, pairs)
