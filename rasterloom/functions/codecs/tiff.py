"""TIFF: strips and tiles, uncompressed, PackBits, LZW and Deflate, several pages."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rasterloom.functions.codecs.base import CodecError, Frame, Info, NeedMore, Raster, Result, Sequence, check_pixels, malformed, pack_bits, unpack, unsupported

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
MAX_ENTRIES = 4096
# Tags that the decoder reads.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, COLORS, TW, TH, TILES, TILE_COUNTS, EXTRA, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322, 323, 324, 325, 338, 339
INTEGERS = {WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, COLORS, TW, TH, TILES, TILE_COUNTS, EXTRA, FORMAT}


def order_of(data: bytes) -> str:
    if len(data) < 4:
        raise NeedMore(4, 0, "tiff_ifd")
    if data[:2] not in (b"II", b"MM"):
        raise malformed("no TIFF signature", 0, "tiff_ifd")
    order = "<" if data[:2] == b"II" else ">"
    if struct.unpack_from(order + "H", data, 2)[0] not in (42,):
        raise unsupported("not a classic TIFF", 2, "tiff_ifd")
    if len(data) < 8:
        raise NeedMore(8, 4, "tiff_ifd")
    return order


def tags_at(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int, int]:
    """Tags {tag: values}, the next directory's place, and the end of this one with its values."""
    if at + 2 > len(data):
        raise NeedMore(at + 2, at, "tiff_ifd")
    n = struct.unpack_from(order + "H", data, at)[0]
    if n > MAX_ENTRIES:
        raise malformed("too many tags", at, "tiff_ifd")
    end = at + 2 + 12 * n + 4
    if end > len(data):
        raise NeedMore(end, at, "tiff_ifd")
    tags, last = {}, end
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = SIZES.get(kind, 1) * count
        place = at + 10 + 12 * i
        if size > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
            if place + size > len(data):
                raise NeedMore(place + size, place, "tiff_ifd")
            last = max(last, place + size)
        raw = data[place : place + size]
        if kind in CODES:
            value = struct.unpack(f"{order}{count}{CODES[kind]}", raw)
        elif kind in (5, 10):
            value = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        else:
            value = (raw,)
        if tag in INTEGERS and not all(isinstance(x, int) and x >= 0 for x in value):
            raise malformed(f"tag {tag} isn't an integer", at, "tiff_ifd")
        if value:
            tags.setdefault(tag, value)
    return tags, struct.unpack_from(order + "I", data, end - 4)[0], last


def directories(data: bytes) -> list[tuple[dict[int, tuple], int]]:
    order = order_of(data)
    at, seen, out = struct.unpack_from(order + "I", data, 4)[0], set(), []
    while at:
        if at in seen:
            raise malformed("directories go in a circle", at, "tiff_ifd")
        seen.add(at)
        tags, following, end = tags_at(data, order, at)
        out.append((tags, end))
        at = following
    if not out:
        raise malformed("no directory", 4, "tiff_ifd")
    return out


def _one(tags: dict, tag: int, default: int | None = None) -> int:
    if tag not in tags:
        if default is None:
            raise malformed(f"tag {tag} is missing", None, "tiff_ifd")
        return default
    return tags[tag][0]


def layout(tags: dict) -> tuple[str, int, int, int, int]:
    """(mode, photometric, samples, bits, sample format)"""
    s, p, f = _one(tags, SAMPLES, 1), _one(tags, PHOTOMETRIC, 1), _one(tags, FORMAT, 1)
    bits = tags.get(BITS, (1,))
    if len(set(bits)) != 1:
        raise unsupported("samples of several sizes", None, "tiff_ifd")
    b = bits[0]
    mode = None
    if s == 1:
        if b == 1 and p in (0, 1):
            mode = "L1"
        elif b == 32 and f in (2, 3):
            mode = "I32" if f == 2 else "F32"
        elif b == 16 and p in (0, 1):
            mode = "L16"
        elif b in (2, 4, 8) and p in (0, 1):
            mode = "L8"
        elif b in (1, 2, 4, 8) and p == 3:
            mode = "P8"
    elif b == 8:
        mode = {(2, 0): "La8", (2, 1): "La8", (3, 2): "Rgb8", (3, 6): "Rgb8", (4, 2): "Rgba8", (4, 5): "Cmyk8"}.get((s, p))
    if mode is None:
        raise unsupported(f"photometric {p} with {s} x {b} bits", None, "tiff_ifd")
    if _one(tags, COMPRESSION, 1) not in (1, 5, 8, 32773, 32946):
        raise unsupported(f"compression {_one(tags, COMPRESSION)}", None, "tiff_ifd")
    if _one(tags, PLANAR, 1) != 1:
        raise unsupported("planes apart", None, "tiff_ifd")
    return mode, p, s, b, f


def inspect(data: bytes) -> Info:
    pages = directories(data)
    tags = pages[0][0]
    w, h = _one(tags, WIDTH), _one(tags, HEIGHT)
    check_pixels(w, h)
    mode, _, _, bits, _ = layout(tags)
    return Info(w, h, mode, bits, len(pages), False, byte_order="LittleEndian" if data[:2] == b"II" else "BigEndian")


def packbits_decode(data: bytes, limit: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:limit])


def packbits_encode(row: bytes) -> bytes:
    """Runs of three and more as runs, everything between as literals."""
    a = np.frombuffer(row, np.uint8)
    if not len(a):
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(a)]
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        n, v = e - s, row[s]
        if n < 3:
            literal.extend([v] * n)
            continue
        flush()
        while n > 0:
            k = min(n, 128)
            if k == 1:
                literal.append(v)
            else:
                out += bytes([257 - k, v])
            n -= k
    flush()
    return bytes(out)


def lzw_decode(data: bytes, limit: int) -> bytes:
    """High-bit-first codes of 9 to 12 bits that widen one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, last, bits, count = bytearray(), 9, None, 0, 0
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        count += 8
        if count < width:
            continue
        code = bits >> (count - width) & ((1 << width) - 1)
        count -= width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code] if code < 256 else b""
        elif code < len(table):
            entry = table[code]
        elif code == len(table):
            entry = last + last[:1]
        else:
            raise malformed("a code has no entry", None, "tiff_strip")
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        if len(out) >= limit:
            break
    return bytes(out[:limit])


def lzw_encode(data: bytes) -> bytes:
    out, bits, count, width = bytearray(), 0, 0, 9
    table: dict[int, int] = {}
    following, prefix = 258, None

    def put(code: int) -> None:
        nonlocal bits, count
        bits = bits << width | code
        count += width
        while count >= 8:
            out.append(bits >> (count - 8) & 255)
            count -= 8
        bits &= (1 << count) - 1

    put(256)
    for b in data:
        if prefix is None:
            prefix = b
            continue
        key = prefix << 8 | b
        if key in table:
            prefix = table[key]
            continue
        put(prefix)
        table[key] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            put(256)
            table, following, width = {}, 258, 9
        prefix = b
    if prefix is not None:
        put(prefix)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if count:
        out.append(bits << (8 - count) & 255)
    return bytes(out)


def _block(data: bytes, at: int, n: int, method: int, size: int, what: str) -> bytes:
    if at + n > len(data):
        raise NeedMore(at + n, at, what)
    raw = data[at : at + n]
    if method == 1:
        out = raw[:size]
    elif method == 32773:
        out = packbits_decode(raw, size)
    elif method == 5:
        out = lzw_decode(raw, size)
    else:
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise malformed(str(e), at, what) from e
    if len(out) < size:
        raise malformed("pixel data end early", at, what)
    return out


def _unpredict(rows: np.ndarray, samples: int, bits: int, order: str) -> np.ndarray:
    kind = np.dtype({8: "u1", 16: order + "u2", 32: order + "u4"}[bits])
    a = rows.view(kind).reshape(len(rows), -1, samples)
    return np.cumsum(a, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(len(rows), -1).view(np.uint8)


def page(data: bytes, tags: dict) -> tuple[Raster, int, int]:
    """The page's raster, where its payload ends, and its length."""
    order = order_of(data)
    w, h = _one(tags, WIDTH), _one(tags, HEIGHT)
    check_pixels(w, h)
    mode, p, s, b, f = layout(tags)
    method, predictor = _one(tags, COMPRESSION, 1), _one(tags, PREDICTOR, 1)
    if predictor not in (1, 2) or (predictor == 2 and b not in (8, 16, 32)):
        raise unsupported(f"predictor {predictor}", None, "tiff_ifd")
    tiled = TILES in tags
    if tiled:
        bw, bh, places, counts = _one(tags, TW), _one(tags, TH), tags[TILES], tags.get(TILE_COUNTS)
    else:
        bw, bh, places, counts = w, min(_one(tags, ROWS, h), h), tags.get(STRIPS), tags.get(COUNTS)
    if not places or not bw or not bh:
        raise malformed("no strips or tiles", None, "tiff_ifd")
    across, down = -(-w // bw), -(-h // bh)
    if len(places) < across * down:
        raise malformed("strips or tiles are missing", None, "tiff_ifd")
    step = (bw * s * b + 7) // 8
    rows = np.zeros((down * bh, across * step), np.uint8)
    end = payload = 0
    for i in range(across * down):
        ty, tx = divmod(i, across)
        n_rows = bh if tiled else min(bh, h - ty * bh)
        n = counts[i] if counts and i < len(counts) else step * n_rows
        if method == 1:
            n = step * n_rows
        part = np.frombuffer(_block(data, places[i], n, method, step * n_rows, "tiff_tile" if tiled else "tiff_strip"), np.uint8).reshape(n_rows, step)
        end, payload = max(end, places[i] + n), payload + n
        if predictor == 2:
            part = _unpredict(part, s, b, order)
        rows[ty * bh : ty * bh + n_rows, tx * step : (tx + 1) * step] = part
    if tiled and (bw * s * b) % 8:
        cells = np.concatenate([unpack(rows[:, i * step : (i + 1) * step], bw, b) for i in range(across)], axis=1)
    else:
        cells = None
    rows, width = rows[:h], across * bw
    invert = p == 0
    palette, alpha = None, None
    if mode in ("L1", "P8") or (mode == "L8" and b < 8):
        v = (cells[:h] if cells is not None else unpack(rows, width, b))[:, :w]
        v = (1 << b) - 1 - v if invert else v
        if mode == "L1":
            pixels = pack_bits(v)
        else:
            pixels = ((v.astype(np.uint16) * 255 // ((1 << b) - 1)).astype(np.uint8) if mode == "L8" else np.ascontiguousarray(v)).tobytes()
        if mode == "P8":
            c = np.array(tags.get(COLORS, ()), np.uint32)
            if len(c) != 3 << b:
                raise malformed("colour map of a wrong size", None, "tiff_ifd")
            palette = (c.reshape(3, -1).T >> 8).astype(np.uint8).tobytes()
    elif mode in ("L16", "F32", "I32"):
        kind = {"L16": "u2", "F32": "f4", "I32": "i4"}[mode]
        v = np.ascontiguousarray(rows).view(order + kind)[:, :w]
        pixels = ((65535 - v) if mode == "L16" and invert else v).astype("<" + kind).tobytes()
    else:
        v = rows.reshape(h, width, s)[:, :w]
        pixels = np.ascontiguousarray(255 - v if invert and mode == "L8" else v).tobytes()
        if mode in ("La8", "Rgba8"):
            alpha = {1: "Premultiplied", 2: "Straight"}.get(_one(tags, EXTRA, 0), "Unspecified")
    return Raster(w, h, mode, pixels, palette, alpha=alpha, byte_order="LittleEndian" if order == "<" else "BigEndian"), end, payload


def decode(data: bytes) -> Result:
    tags, end = directories(data)[0]
    image, last, _ = page(data, tags)
    return Result(image, max(end, last))


def inspect_basic(data: bytes) -> Info:
    """The first directory alone; frames aren't counted (0)."""
    order = order_of(data)
    tags, _, _ = tags_at(data, order, struct.unpack_from(order + "I", data, 4)[0])
    w, h = _one(tags, WIDTH), _one(tags, HEIGHT)
    check_pixels(w, h)
    mode, _, _, bits, _ = layout(tags)
    return Info(w, h, mode, bits, 0, False, byte_order="LittleEndian" if order == "<" else "BigEndian")


def decode_page(data: bytes, index: int) -> tuple[Raster, int]:
    """One page and the number of pages."""
    pages = directories(data)
    if not 0 <= index < len(pages):
        raise CodecError("Parameter", f"there is no page {index}")
    return page(data, pages[index][0])[0], len(pages)


def decode_sequence(data: bytes) -> Result:
    frames, last = [], 0
    for tags, end in directories(data):
        image, stop, _ = page(data, tags)
        last = max(last, end, stop)
        frames.append(Frame(image, (0, 0, image.width, image.height)))
    w, h = max(f.image.width for f in frames), max(f.image.height for f in frames)
    return Result(Sequence(w, h, frames, "UntimedPages" if len(frames) > 1 else "SingleFrame", "Page"), last)


def metadata_bytes(data: bytes) -> int:
    tags, end = directories(data)[0]
    _, stop, payload = page(data, tags)
    return max(end, stop) - payload


PHOTO = {"L1": (1, 1, 1, 1), "L8": (1, 1, 8, 1), "La8": (1, 2, 8, 1), "L16": (1, 1, 16, 1), "F32": (1, 1, 32, 3), "I32": (1, 1, 32, 2), "Rgb8": (2, 3, 8, 1), "Rgba8": (2, 4, 8, 1), "Cmyk8": (5, 4, 8, 1)}
METHODS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}


def encode_pages(images: list[Raster], compression: str = "none", predictor: bool = False) -> bytes:
    """Little-endian pages, each a strip and then its directory, on 16-byte bounds."""
    if compression not in METHODS or not images:
        raise CodecError("Parameter", f"compression {compression!r}")
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for n, image in enumerate(images):
        if image.mode not in PHOTO:
            raise unsupported(f"TIFF doesn't take {image.mode}")
        image.validate()
        photo, s, b, f = PHOTO[image.mode]
        rows = np.frombuffer(image.pixels, np.uint8).reshape(image.height, -1)
        apply = predictor and compression in ("lzw", "deflate") and b in (8, 16)
        if apply:
            a = rows.view(np.uint8 if b == 8 else "<u2").reshape(image.height, image.width, s)
            d = a.copy()
            d[:, 1:] -= a[:, :-1]
            rows = np.ascontiguousarray(d).reshape(image.height, -1).view(np.uint8)
        raw = rows.tobytes()
        if compression == "lzw":
            raw = lzw_encode(raw)
        elif compression == "deflate":
            raw = zlib.compress(raw)
        elif compression == "packbits":
            raw = b"".join(packbits_encode(r.tobytes()) for r in rows)
        if n:
            out += bytes(-len(out) % 16)
        start = len(out)
        out += raw + bytes(len(raw) % 2)
        tags = [(WIDTH, 4, [image.width]), (HEIGHT, 4, [image.height]), (BITS, 3, [b] * s), (COMPRESSION, 3, [METHODS[compression]]), (PHOTOMETRIC, 3, [photo]), (STRIPS, 4, [start]), (SAMPLES, 3, [s]), (ROWS, 4, [image.height]), (COUNTS, 4, [len(raw)]), (PLANAR, 3, [1])]
        if apply:
            tags.append((PREDICTOR, 3, [2]))
        if image.mode in ("La8", "Rgba8"):
            tags.append((EXTRA, 3, [2]))
        tags.append((FORMAT, 3, [f] * s))
        at = len(out)
        struct.pack_into("<I", out, link, at)
        extra, more = at + 2 + 12 * len(tags) + 4, b""
        out += struct.pack("<H", len(tags))
        for tag, kind, values in tags:
            body = struct.pack(f"<{len(values)}{CODES[kind]}", *values)
            if len(body) > 4:
                place, body = extra + len(more), body
                more += body + bytes(len(body) % 2)
                body = struct.pack("<I", place)
            out += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        link = len(out)
        out += bytes(4) + more
    return bytes(out)


def encode(image: Raster, compression: str = "none", predictor: bool = False) -> bytes:
    return encode_pages([image], compression, predictor)


def encode_sequence(seq: Sequence, compression: str = "none") -> bytes:
    return encode_pages([f.image for f in seq.frames], compression)
