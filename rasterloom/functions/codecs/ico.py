"""ICO and CUR."""

from __future__ import annotations

import struct

import numpy as np

from rasterloom.functions.codecs import bmp, png
from rasterloom.functions.codecs.base import MAX_SIDE, CodecError, Info, NeedMore, Raster, Result, malformed, unpack, unsupported


def _directory(data: bytes) -> tuple[int, list[tuple]]:
    if len(data) < 6:
        raise NeedMore(6, 0, "ico_header")
    zero, kind, n = struct.unpack_from("<HHH", data)
    if zero or kind not in (1, 2) or not n:
        raise malformed("no icon directory", 0, "ico_header")
    if len(data) < 6 + 16 * n:
        raise NeedMore(6 + 16 * n, 6, "ico_directory")
    return kind, [struct.unpack_from("<BBBBHHII", data, 6 + 16 * i) for i in range(n)]


def best(entries: list[tuple]) -> tuple:
    """The largest area, 0 standing for 256; the first of equals."""
    return max(entries, key=lambda e: (e[0] or 256) * (e[1] or 256))


def _dib(body: bytes, cursor: bool) -> tuple[int, int, int]:
    name = "ico_cur_dib" if cursor else "ico_dib"
    if len(body) < 40:
        raise malformed("the entry's header is too short", None, name)
    size, w, h2, _, bits = struct.unpack_from("<IiiHH", body)
    if size < 40 or w <= 0 or h2 <= 0 or w > MAX_SIDE or h2 // 2 > MAX_SIDE:
        raise malformed("the entry's header is wrong", None, name)
    return w, h2 // 2, bits


def _entry(data: bytes) -> tuple[int, tuple, bytes]:
    kind, entries = _directory(data)
    e = best(entries)
    size, at = e[6], e[7]
    if at + size > len(data):
        raise NeedMore(at + size, at, "ico_entry")
    return kind, e, data[at : at + size]


def inspect(data: bytes) -> Info:
    kind, e, body = _entry(data)
    hot = (e[4], e[5]) if kind == 2 else None
    if body.startswith(png.SIGNATURE):
        i = png.inspect(body)
        return Info(i.width, i.height, i.mode, i.bit_depth, hotspot=hot)
    w, h, bits = _dib(body, kind == 2)
    return Info(w, h, "Rgba8", bits, hotspot=hot)


def decode(data: bytes) -> Result:
    kind, e, body = _entry(data)
    hot = (e[4], e[5]) if kind == 2 else None
    if body.startswith(png.SIGNATURE):
        image = png.decode(body).value
    else:
        image = _decode_dib(body, kind == 2)
    image.hotspot = hot
    return Result(image, e[7] + e[6])


def _decode_dib(body: bytes, cursor: bool) -> Raster:
    """A bitmap of twice the height: colours, then a mask whose set bits are transparent."""
    w, h, bits = _dib(body, cursor)
    size, used = struct.unpack_from("<I", body)[0], struct.unpack_from("<I", body, 32)[0]
    name = "ico_cur_dib" if cursor else "ico_dib"
    if bits not in (1, 4, 8, 24, 32):
        raise unsupported(f"{bits} bits", None, name)
    at = size
    colors = None
    if bits <= 8:
        n = min(used or 1 << bits, 1 << bits)
        if len(body) < at + 4 * n:
            raise malformed("the palette ends early", None, name)
        colors = np.frombuffer(body, np.uint8, 4 * n, at).reshape(-1, 4)[:, 2::-1]
        at += 4 * n
    step = bmp.stride(bits, w)
    if len(body) < at + step * h:
        raise malformed("pixels end early", None, name)
    rows = np.frombuffer(body, np.uint8, step * h, at).reshape(h, step)[::-1]
    at += step * h
    mask_step = bmp.stride(1, w)
    mask = None
    if len(body) >= at + mask_step * h:
        mask = unpack(np.frombuffer(body, np.uint8, mask_step * h, at).reshape(h, mask_step)[::-1], w, 1)
    out = np.zeros((h, w, 4), np.uint8)
    if bits == 32:
        out[:] = rows.reshape(h, w, 4)[:, :, [2, 1, 0, 3]]
        return Raster(w, h, "Rgba8", out.tobytes(), alpha="Straight")
    if bits == 24:
        out[:, :, :3] = rows[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1]
    else:
        index = unpack(rows, w, bits)
        if int(index.max()) >= len(colors):
            raise malformed("an index has no colour", None, name)
        out[:, :, :3] = colors[index]
    out[:, :, 3] = 255 if mask is None else np.where(mask == 1, 0, 255)
    return Raster(w, h, "Rgba8", out.tobytes(), alpha="Straight")


def metadata_bytes(data: bytes) -> int:
    return 6 + 16 * len(_directory(data)[1])


def encode(image: Raster, entry_type: str = "png", sizes: tuple[int, int] | None = None) -> bytes:
    """One entry of the raster's size, at most 256 a side; given sizes must be the raster's."""
    image.validate()
    w, h = image.width, image.height
    if w > 256 or h > 256:
        raise CodecError("Parameter", "an icon has at most 256 pixels a side")
    if sizes is not None and tuple(sizes) != (w, h):
        raise CodecError("Parameter", "sizes must be the dimensions of the image")
    if entry_type == "png":
        body = png.encode(image)
    elif entry_type == "bmp":
        if image.mode not in ("Rgb8", "Rgba8"):
            raise unsupported(f"a bitmap entry doesn't take {image.mode}")
        rgba = image.rgba()
        mask = np.zeros((h, bmp.stride(1, w)), np.uint8)
        packed = np.packbits(rgba[::-1, :, 3] == 0, axis=1)
        mask[:, : packed.shape[1]] = packed
        body = struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 32, 0, 4 * w * h + mask.size, 0, 0, 0, 0) + rgba[::-1, :, [2, 1, 0, 3]].tobytes() + mask.tobytes()
    else:
        raise CodecError("Parameter", f"entry type {entry_type!r}")
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, w % 256, h % 256, 0, 0, 1, 32, len(body), 22) + body
