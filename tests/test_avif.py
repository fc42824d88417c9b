"""AVIF boxes, tracks and AV1 units, from bytes made here."""

import struct

import pytest

from rasterloom.functions import tables
from rasterloom.functions.codecs import avif
from rasterloom.functions.codecs.base import CodecError


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *parts):
    return box(kind, bytes(4), *parts)


FTYP = box(b"ftyp", b"avif", bytes(4), b"avif")


def test_properties(spark):
    ipco = box(
        b"ipco", full(b"ispe", struct.pack(">II", 30, 20)), full(b"pixi", b"\x03\x0a\x0a\x0a"), box(b"irot", b"\x03"), box(b"imir", b"\x01"),
        box(b"colr", b"nclx", struct.pack(">HHH", 1, 13, 6), b"\x80"), full(b"auxC", b"urn:alpha\0"), box(b"av1C", b"\x81\x09\x4c\0"), box(b"pasp", struct.pack(">II", 2, 1)),
    )
    links = b"".join(bytes([0x80 | i if i == 1 else i]) for i in range(1, 9))
    ipma = full(b"ipma", struct.pack(">I", 1), struct.pack(">H", 1), bytes([8]), links)
    data = FTYP + full(b"meta", full(b"pitm", struct.pack(">H", 1)), box(b"iprp", ipco, ipma))
    got = {kind: (numbers, text) for _, kind, _, numbers, text in avif.properties(data)}
    assert got == {"ispe": ([30, 20], None), "pixi": ([10, 10, 10], None), "irot": ([3], None), "imir": ([1], None), "colr": ([1, 13, 6, 1], "nclx"), "auxC": (None, "urn:alpha"), "av1C": ([0, 9, 10, 0, 1, 1], None), "pasp": ([2, 1], None)}
    assert avif.inspect(data).bit_depth == 10 and avif.properties(data)[0][2]
    tables.register(spark)
    spark.createDataFrame([(bytearray(data),)], "content binary").createOrReplaceTempView("__avif")
    assert spark.sql("SELECT p.* FROM __avif, LATERAL avif_properties(content) p").count() == 8


def test_sample_tables():
    stbl = box(
        b"stbl", full(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 5)), full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 3, 1)),
        full(b"stsz", struct.pack(">II5I", 0, 5, 100, 50, 40, 30, 20)), full(b"stco", struct.pack(">I2I", 2, 1000, 2000)),
    )
    moov = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl))))
    want = [(0, 0, 1000, 100, 0, 10), (0, 1, 1100, 50, 10, 10), (0, 2, 2000, 40, 20, 5), (0, 3, 2040, 30, 25, 5), (0, 4, 2070, 20, 30, 5)]
    assert avif.samples(FTYP + moov) == want
    with pytest.raises(CodecError):
        avif.samples(FTYP + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl"))))))


def test_units_and_sequence_header():
    bits = "001" + "1" + "1" + "00100" + "0110" + "0101" + f"{99:07b}" + f"{49:06b}"
    payload = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    stream = b"\x12\x00" + bytes([0x0A, len(payload)]) + payload + b"\x36\x48" + b"\x81\x01" + bytes(129) + b"\x18xyz"
    units = avif.obus(stream)
    assert [(t, s, p, n) for t, s, p, _, n in units] == [(2, 0, 0, 0), (1, 0, 0, len(payload)), (6, 2, 1, 129), (3, 0, 0, 3)]
    assert avif.sequence_header(payload) == {"profile": 1, "still": 1, "reduced": 1, "level": 4, "width": 100, "height": 50}
    long = "000" + "0" + "0" + "0" + "0" + "00000" + "0" * 12 + "01000" + "0" + "0011" + "0011" + "1111" + "0111"
    assert avif.sequence_header(int(long.ljust(56, "0"), 2).to_bytes(7, "big")) == {"profile": 0, "still": 0, "reduced": 0, "level": 8, "width": 16, "height": 8}
    with pytest.raises(CodecError):
        avif.obus(b"\x80")
    with pytest.raises(CodecError):
        avif.sequence_header(b"\x18")
