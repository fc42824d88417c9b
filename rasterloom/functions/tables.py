"""Table functions over one blob: chunks, markers, tags and boxes as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rasterloom.functions.codecs import avif, gif, png, tiff, webp
from rasterloom.functions.codecs.base import CodecError


@udtf(returnType="ordinal int, offset bigint, kind string, length bigint, crc_ok boolean")
class PngChunks:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            for i, (kind, payload, at, good) in enumerate(png.chunks(bytes(data or b""), False)):
                yield i, at, kind.decode("latin1"), len(payload), good
        except CodecError:
            return


@udtf(returnType="ordinal int, offset bigint, marker int, length bigint")
class JpegMarkers:
    """Markers to the first scan."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        d, at, i = bytes(data or b""), 2, 0
        if d[:2] != b"\xff\xd8":
            return
        while at + 4 <= len(d):
            if d[at] != 255:
                return
            m, n = d[at + 1], struct.unpack_from(">H", d, at + 2)[0]
            yield i, at, m, n
            if m == 0xDA:
                return
            at, i = at + 2 + n, i + 1


@udtf(returnType="ordinal int, offset bigint, kind string, length bigint")
class RiffChunks:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            for i, (kind, at, n) in enumerate(webp.chunks(bytes(data or b""))[0]):
                yield i, at - 8, kind.decode("latin1"), n
        except CodecError:
            return


@udtf(returnType="frame int, `left` int, top int, width int, height int, interlaced boolean, delay int, disposal int, transparent int")
class GifFrames:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            images = gif._walk(bytes(data or b""), False)[3]
        except CodecError:
            return
        for i, (left, top, w, h, flags, _, control, _, _) in enumerate(images):
            dispose, delay, clear = control or (0, 0, None)
            yield i, left, top, w, h, bool(flags & 64), delay, dispose, clear


@udtf(returnType="page int, tag int, count int, first_value string")
class TiffTags:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            pages = tiff.directories(bytes(data or b""))
        except CodecError:
            return
        for p, (tags, _) in enumerate(pages):
            for tag, values in sorted(tags.items()):
                yield p, tag, len(values), str(values[0]) if values else None


@udtf(returnType="path string, offset bigint, length bigint")
class BmffBoxes:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            for path, at, _, end in avif.boxes(bytes(data or b"")):
                yield path, at, end - at
        except CodecError:
            return


@udtf(returnType="item bigint, kind string, essential boolean, numbers array<bigint>, text string")
class AvifProperties:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            yield from avif.properties(bytes(data or b""))
        except CodecError:
            return


@udtf(returnType="track int, sample int, offset bigint, size bigint, time bigint, duration bigint")
class AvifSamples:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            yield from avif.samples(bytes(data or b""))
        except CodecError:
            return


@udtf(returnType="ordinal int, type int, temporal int, spatial int, offset bigint, size bigint")
class Av1Units:
    def eval(self, data: bytes) -> Iterator[tuple]:
        try:
            for i, unit in enumerate(avif.obus(bytes(data or b""))):
                yield i, *unit
        except CodecError:
            return


FUNCTIONS = {"png_chunks": PngChunks, "jpeg_markers": JpegMarkers, "riff_chunks": RiffChunks, "gif_frames": GifFrames, "tiff_tags": TiffTags, "bmff_boxes": BmffBoxes, "avif_properties": AvifProperties, "avif_samples": AvifSamples, "av1_units": Av1Units}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
