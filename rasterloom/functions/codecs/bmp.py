"""BMP."""

from __future__ import annotations

import struct

import numpy as np

from rasterloom.functions.codecs.base import MAX_SIDE, CodecError, Info, NeedMore, Raster, Result, check_pixels, malformed, unpack, unsupported

GRAY2 = bytes([0, 0, 0, 255, 255, 255])


def stride(bits: int, width: int) -> int:
    return (bits * width + 31) // 32 * 4


def _head(data: bytes) -> dict:
    if len(data) < 2:
        raise NeedMore(2, 0, "bmp_signature") if b"BM".startswith(data) else malformed("no BMP signature", 0, "bmp_signature")
    if data[:2] != b"BM":
        raise malformed("no BMP signature", 0, "bmp_signature")
    if len(data) < 18:
        raise NeedMore(18, 14, "bmp_dib_header")
    offset, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size != 12 and size < 40:
        raise unsupported(f"DIB header of {size} bytes", 14, "bmp_dib_header")
    if len(data) < 14 + size:
        raise NeedMore(14 + size, 14, "bmp_dib_header")
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        method, used, entry, flip = 0, 0, 3, True
    else:
        w, h, _, bits, method, _, _, _, used, _ = struct.unpack_from("<iiHHIIiiII", data, 18)
        entry, flip = 4, h >= 0
        h = abs(h)
    if w <= 0 or h <= 0:
        raise CodecError("Dimensions", "the image has no pixels", offset=18)
    at, masks = 14 + size, None
    if method in (3, 6):
        n = 3 if method == 3 else 4
        if size >= 52:
            masks = struct.unpack_from("<4I" if size >= 56 else "<3I", data, 54)
        else:
            if len(data) < at + 4 * n:
                raise NeedMore(at + 4 * n, at, "bmp_bitfields")
            masks = struct.unpack_from(f"<{n}I", data, at)
            at += 4 * n
        if bits not in (16, 32):
            raise malformed("bit fields need 16 or 32 bits", 28, "bmp_bitfields")
    elif method not in (0, 1, 2) or (method == 1 and bits != 8) or (method == 2 and bits != 4):
        raise unsupported(f"compression {method} with {bits} bits", 30, "bmp_dib_header")
    if bits not in (1, 4, 8, 16, 24, 32):
        raise unsupported(f"{bits} bits", 28, "bmp_dib_header")
    palette = None
    if bits <= 8:
        count = min(used or 1 << bits, 1 << bits)
        if offset > at:
            count = min(count, (offset - at) // entry)
        if len(data) < at + count * entry:
            raise NeedMore(at + count * entry, at, "bmp_palette")
        raw = np.frombuffer(data, np.uint8, count * entry, at).reshape(-1, entry)
        palette = raw[:, 2::-1].tobytes()
    return {"w": w, "h": h, "bits": bits, "method": method, "flip": flip, "offset": offset, "masks": masks, "palette": palette}


def _indexed_mode(bits: int, palette: bytes) -> str:
    p = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    if bits == 1 and palette == GRAY2:
        return "L1"
    if bits == 8 and len(p) == 256 and (p == np.arange(256)[:, None]).all():
        return "L8"
    return "P8"


def inspect(data: bytes) -> Info:
    d = _head(data)
    if d["bits"] <= 8:
        mode = _indexed_mode(d["bits"], d["palette"])
    else:
        mode = "Rgba8" if d["masks"] and len(d["masks"]) > 3 and d["masks"][3] else "Rgb8"
    return Info(d["w"], d["h"], mode, d["bits"])


def _rle(data: bytes, at: int, w: int, h: int, four: bool) -> np.ndarray:
    """Run-length rows, bottom first: runs, escapes for end of line, end, moves and literals."""
    out = np.zeros(w * h, np.uint8)
    x = y = 0
    n = len(data)

    def put(values: list[int]) -> None:
        nonlocal x
        for v in values:
            if x < w and y < h:
                out[y * w + x] = v
            x += 1

    while y < h:
        if at + 2 > n:
            raise malformed("runs end early", at, "bmp_rle")
        count, value = data[at], data[at + 1]
        at += 2
        if count:
            put([value >> 4 if i % 2 == 0 else value & 15 for i in range(count)] if four else [value] * count)
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            break
        elif value == 2:
            if at + 2 > n:
                raise malformed("a move ends early", at, "bmp_rle")
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = (value + 1) // 2 if four else value
            if at + size > n:
                raise malformed("literals end early", at, "bmp_rle")
            raw = data[at : at + size]
            put([raw[i // 2] >> 4 if i % 2 == 0 else raw[i // 2] & 15 for i in range(value)] if four else list(raw))
            at += size + size % 2
    return out.reshape(h, w)


def extract(px: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(px.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    width = mask.bit_length() - shift
    v = (px & np.uint32(mask)) >> np.uint32(shift)
    return (v >> np.uint32(width - 8) if width >= 8 else v * 255 // ((1 << width) - 1)).astype(np.uint8)


def decode(data: bytes) -> Result:
    d = _head(data)
    w, h, bits = d["w"], d["h"], d["bits"]
    if w > MAX_SIDE or h > MAX_SIDE:
        raise CodecError("Dimensions", f"a side is over {MAX_SIDE}", offset=18)
    check_pixels(w, h)
    at = d["offset"]
    if d["method"] in (1, 2):
        rows = _rle(data, at, w, h, d["method"] == 2)
        end = len(data)
    else:
        step = stride(bits, w)
        end = at + step * h
        if end > len(data):
            raise NeedMore(end, at, "bmp_pixels")
        rows = np.frombuffer(data, np.uint8, step * h, at).reshape(h, step)
    if d["flip"]:
        rows = rows[::-1]
    if bits <= 8:
        index = rows if d["method"] in (1, 2) else unpack(rows, w, bits)
        mode = _indexed_mode(bits, d["palette"])
        if mode == "L1":
            return Result(Raster(w, h, "L1", np.packbits(index, axis=1).tobytes()), end)
        if index.size and int(index.max()) * 3 >= len(d["palette"]):
            raise malformed("an index has no colour", at, "bmp_palette")
        if mode == "L8":
            return Result(Raster(w, h, "L8", np.ascontiguousarray(index).tobytes()), end)
        return Result(Raster(w, h, "P8", np.ascontiguousarray(index).tobytes(), d["palette"]), end)
    if bits == 24:
        return Result(Raster(w, h, "Rgb8", rows[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1].tobytes()), end)
    if bits == 16:
        px = np.ascontiguousarray(rows[:, : 2 * w]).view("<u2").astype(np.uint32)
        masks = d["masks"] or (0x7C00, 0x03E0, 0x001F)
    else:
        px = np.ascontiguousarray(rows[:, : 4 * w]).view("<u4").astype(np.uint32)
        masks = d["masks"] or (0xFF0000, 0xFF00, 0xFF)
    alpha = len(masks) > 3 and masks[3]
    planes = [extract(px, m) for m in masks[: 4 if alpha else 3]]
    return Result(Raster(w, h, "Rgba8" if alpha else "Rgb8", np.stack(planes, axis=2).tobytes(), alpha="Straight" if alpha else None), end)


def metadata_bytes(data: bytes) -> int:
    _head(data)
    return struct.unpack_from("<I", data, 10)[0]


def encode(image: Raster) -> bytes:
    image.validate()
    w, h = image.width, image.height
    if image.mode == "L1":
        bits, colors, body = 1, GRAY2, np.frombuffer(image.pixels, np.uint8).reshape(h, -1)
    elif image.mode in ("L8", "P8"):
        gray = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
        colors = gray if image.mode == "L8" else image.palette
        if not colors:
            raise CodecError("Parameter", "an indexed image needs a palette")
        bits, body = 8, np.frombuffer(image.pixels, np.uint8).reshape(h, w)
    elif image.mode in ("Rgb8", "Rgba8"):
        a = np.frombuffer(image.pixels, np.uint8).reshape(h, w, -1)
        bits, colors = 8 * a.shape[2], b""
        body = a[:, :, [2, 1, 0, 3][: a.shape[2]]].reshape(h, -1)
    else:
        raise unsupported(f"BMP doesn't take {image.mode}")
    step, n = stride(bits, w), len(colors) // 3
    rows = np.zeros((h, step), np.uint8)
    rows[:, : body.shape[1]] = body
    table = np.zeros((n, 4), np.uint8)
    if n:
        table[:, :3] = np.frombuffer(colors, np.uint8).reshape(-1, 3)[:, ::-1]
    offset = 54 + 4 * n
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", offset + step * h, 0, offset, 40, w, h, 1, bits, 0, step * h, 3780, 3780, n, n)
    return head + table.tobytes() + rows[::-1].tobytes()
