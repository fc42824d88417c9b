"""GIF."""

from __future__ import annotations

import struct

import numpy as np

from rasterloom.functions.codecs.base import CodecError, Frame, Info, NeedMore, Raster, Result, Sequence, check_pixels, malformed, unsupported

PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def interlaced_rows(h: int) -> list[int]:
    return [y for first, step in PASSES for y in range(first, h, step)]


def lzw_decode(data: bytes, minimum: int, limit: int) -> bytes:
    """At most `limit` bytes of a low-bit-first code stream of up to 12 bits."""
    if not 1 <= minimum <= 11:
        raise malformed(f"minimum code size {minimum}", None, "gif_image_data")
    clear, end = 1 << minimum, (1 << minimum) + 1
    base = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    table, width, last = list(base), minimum + 1, None
    out = bytearray()
    bits = count = 0
    for byte in data:
        bits |= byte << count
        count += 8
        while count >= width:
            code = bits & ((1 << width) - 1)
            bits >>= width
            count -= width
            if code == clear:
                table, width, last = list(base), minimum + 1, None
                continue
            if code == end:
                return bytes(out[:limit])
            if last is None:
                if code > end:
                    raise malformed("a code has no entry", None, "gif_image_data")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
            elif code == len(table) and len(table) < 4096:
                entry = last + last[:1]
            else:
                raise malformed("a code has no entry", None, "gif_image_data")
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
            if len(out) >= limit:
                return bytes(out[:limit])
    return bytes(out[:limit])


def lzw_encode(data: bytes, minimum: int) -> bytes:
    clear, end = 1 << minimum, (1 << minimum) + 1
    out = bytearray()
    bits = count = 0

    def put(code: int, width: int) -> None:
        nonlocal bits, count
        bits |= code << count
        count += width
        while count >= 8:
            out.append(bits & 255)
            bits >>= 8
            count -= 8

    width, table, following = minimum + 1, {}, end + 1
    put(clear, width)
    prefix = None
    for b in data:
        if prefix is None:
            prefix = b
            continue
        key = prefix << 8 | b
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix, width)
        if following < 4096:
            table[key] = following
            if following == 1 << width:
                width += 1
            following += 1
        else:
            put(clear, width)
            width, table, following = minimum + 1, {}, end + 1
        prefix = b
    if prefix is not None:
        put(prefix, width)
        if following == 1 << width and width < 12:
            width += 1
    put(end, width)
    if count:
        out.append(bits & 255)
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise NeedMore(at + 1, at, "gif_block")
        n = data[at]
        if at + 1 + n > len(data):
            raise NeedMore(at + 1 + n, at, "gif_block")
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _table(data: bytes, at: int, flags: int) -> tuple[bytes | None, int]:
    if not flags & 128:
        return None, at
    n = 3 << (flags & 7) + 1
    if at + n > len(data):
        raise NeedMore(at + n, at, "gif_image")
    return data[at : at + n], at + n


def _walk(data: bytes, pixels: bool):
    """Screen and images. An image: (left, top, w, h, flags, palette, graphic control, code size, code stream)."""
    if len(data) < 6:
        raise NeedMore(6, 0, "gif_image") if b"GIF87a".startswith(data) or b"GIF89a".startswith(data) else malformed("no GIF signature", 0, "gif_image")
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise malformed("no GIF signature", 0, "gif_image")
    if len(data) < 13:
        raise NeedMore(13, 6, "gif_image")
    w, h, flags, background = struct.unpack_from("<HHBB", data, 6)
    common, at = _table(data, 13, flags)
    images, control, loops, said, spans = [], None, None, [], 0
    while True:
        if at >= len(data):
            if not images:
                raise NeedMore(at + 1, at, "gif_block")
            break
        kind = data[at]
        if kind == 0x3B:
            at += 1
            break
        if kind == 0x21:
            if at + 2 > len(data):
                raise NeedMore(at + 2, at, "gif_extension")
            label, body_at = data[at + 1], at + 2
            body, at = _blocks(data, body_at)
            if label == 0xF9:
                if len(body) != 4:
                    said.append(("RecoverableMalformed", "SequenceDecode", body_at, "gif_graphic_control"))
                if len(body) >= 4:
                    f, delay, index = struct.unpack_from("<BHB", body)
                    control = (f >> 2 & 7, delay, index if f & 1 else None)
            elif label == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14 and body[11] == 1:
                loops = struct.unpack_from("<H", body, 12)[0]
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise NeedMore(at + 10, at, "gif_image")
            left, top, iw, ih, f = struct.unpack_from("<HHHHB", data, at + 1)
            own, at2 = _table(data, at + 10, f)
            if at2 >= len(data):
                raise NeedMore(at2 + 1, at2, "gif_image_data")
            stream, end = _blocks(data, at2 + 1)
            spans += end - at2
            images.append((left, top, iw, ih, f, own or common, control, data[at2], stream if pixels else b""))
            control, at = None, end
        else:
            raise malformed(f"block {kind:#x}", at, "gif_block")
    if not images:
        raise malformed("no image", at, "gif_image")
    cw, ch = max([w, *(i[0] + i[2] for i in images)]), max([h, *(i[1] + i[3] for i in images)])
    return cw, ch, background, images, loops, said, at, spans


def inspect(data: bytes) -> Info:
    w, h, _, images, *_ = _walk(data, False)
    check_pixels(w, h)
    return Info(w, h, "P8" if images[0][5] else "L8", 8, len(images), len(images) > 1)


def _image(w: int, h: int, f: int, palette: bytes | None, control, size: int, stream: bytes) -> Raster:
    check_pixels(w, h)
    raw = lzw_decode(stream, size, w * h)
    if len(raw) < w * h:
        raise malformed("image data end early", None, "gif_image_data")
    index = np.frombuffer(raw, np.uint8).reshape(h, w)
    if f & 64:
        out = np.empty_like(index)
        out[interlaced_rows(h)] = index
        index = out
    transparent = control[2] if control else None
    if palette is None:
        return Raster(w, h, "L8", index.tobytes())
    p = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    if transparent is None and (p == np.arange(len(p))[:, None]).all():
        return Raster(w, h, "L8", index.tobytes())
    most = int(index.max())
    if most >= len(p):
        palette = palette + bytes(3 * (most + 1 - len(p)))
    alpha = b""
    if transparent is not None and transparent < len(palette) // 3:
        alpha = b"\xff" * transparent + b"\0"
    return Raster(w, h, "P8", index.tobytes(), palette, alpha, alpha="Straight" if alpha else None)


def decode_sequence(data: bytes) -> Result:
    w, h, _, images, loops, said, end, _ = _walk(data, True)
    check_pixels(w, h)
    frames = []
    for left, top, iw, ih, f, palette, control, size, stream in images:
        dispose, delay, _ = control or (0, 0, None)
        frames.append(Frame(_image(iw, ih, f, palette, control, size, stream), (left, top, iw, ih), (delay, 100), dispose, None, bool(f & 64)))
    kind = "TimedAnimation" if len(frames) > 1 else "SingleFrame"
    return Result(Sequence(w, h, frames, kind, "SourceRect", loops), end, said)


def decode(data: bytes) -> Result:
    r = decode_sequence(data)
    return Result(r.value.frames[0].image, r.consumed, r.diagnostics)


def metadata_bytes(data: bytes) -> int:
    *_, end, spans = _walk(data, False)
    return end - spans


def indexed(image: Raster) -> tuple[np.ndarray, bytes, int | None]:
    """Indices, palette and transparent index. Up to 256 colours are kept exactly, in order of first use; more
    are cut by median: the box with the most pixels is split at its widest channel's median."""
    if image.mode == "P8":
        p = image.palette or b""
        clear = image.palette_alpha.find(b"\0") if image.palette_alpha else -1
        return image.array()[:, :, 0], p, clear if clear >= 0 else None
    if image.mode in ("L8", "L1"):
        a = image.array()[:, :, 0]
        levels, index = np.unique(a, return_inverse=True)
        return index.reshape(a.shape).astype(np.uint8), np.repeat(levels, 3).astype(np.uint8).tobytes(), None
    if image.mode not in ("Rgb8", "Rgba8"):
        raise unsupported(f"GIF doesn't take {image.mode}")
    a = image.array().astype(np.uint32)
    clear = None
    if image.mode == "Rgba8":
        hidden = a[:, :, 3] < 128
        if hidden.any():
            clear = hidden
    code = a[:, :, 0] << 16 | a[:, :, 1] << 8 | a[:, :, 2]
    colors, first, index, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    room = 255 if clear is not None else 256
    if len(colors) > room:
        groups = _median_cut(colors, n, room)
        palette = np.array([np.average(_rgb(colors[g]), axis=0, weights=n[g]) for g in groups]).round().astype(np.uint8)
        to = np.empty(len(colors), np.int64)
        for i, g in enumerate(groups):
            to[g] = i
    else:
        order = np.argsort(first)
        palette, to = _rgb(colors[order]).astype(np.uint8), np.empty(len(colors), np.int64)
        to[order] = np.arange(len(colors))
    out = to[index].reshape(code.shape).astype(np.uint8)
    table = palette.tobytes()
    if clear is not None:
        out[clear] = len(palette)
        return out, table + b"\0\0\0", len(palette)
    return out, table, None


def _rgb(code: np.ndarray) -> np.ndarray:
    return np.stack([code >> 16, code >> 8 & 255, code & 255], axis=-1)


def _median_cut(colors: np.ndarray, n: np.ndarray, most: int) -> list[np.ndarray]:
    rgb, boxes = _rgb(colors).astype(np.int64), [np.arange(len(colors))]
    while len(boxes) < most:
        size = [int(n[b].sum()) if len(b) > 1 else -1 for b in boxes]
        i = int(np.argmax(size))
        if size[i] < 0:
            break
        b = boxes.pop(i)
        axis = int(np.argmax(np.ptp(rgb[b], axis=0)))
        b = b[np.argsort(rgb[b, axis], kind="stable")]
        half = np.cumsum(n[b])
        cut = min(max(1, int(np.searchsorted(half, half[-1] / 2))), len(b) - 1)
        boxes += [b[:cut], b[cut:]]
    return boxes


def encode_frames(frames: list[Frame], w: int, h: int, loops: int | None = None, interlace: bool | None = None, disposal: int | None = None, transparency: bool = True, color_table: int = 1) -> bytes:
    """disposal: of all frames instead of their own. color_table: 0 puts the first frame's palette into the
    screen's header, and frames of the same palette need none of their own."""
    if not frames or not 0 < w < 65536 or not 0 < h < 65536:
        raise CodecError("Dimensions", "a GIF screen has 1 to 65535 pixels a side")
    parts, later = [], len(frames) > 1 or loops is not None
    common, screen = None, 0
    for f in frames:
        num, den = f.duration or (0, 1)
        if num * 100 % den or num * 100 // den > 65535:
            raise CodecError("Parameter", "a delay must be whole centiseconds below 65536")
        index, palette, clear = indexed(f.image)
        clear = clear if transparency else None
        later |= clear is not None
        n = max(2, (max(len(palette) // 3, 4) - 1).bit_length())
        table = palette + bytes((3 << n) - len(palette))
        if not color_table and common is None:
            common, screen = table, 128 | n - 1
        x, y, fw, fh = f.rect
        delay, code = num * 100 // den, f.disposal if disposal is None else disposal
        if clear is not None or code or delay:
            parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", code << 2 | (clear is not None), delay, clear or 0) + b"\0")
        woven = interlace if interlace is not None else len(frames) == 1 and fw >= 16 and fh >= 16
        rows = index[interlaced_rows(fh)] if woven else index
        own = b"" if table == common else table
        parts.append(b"\x2c" + struct.pack("<HHHHB", x, y, fw, fh, (128 | n - 1 if own else 0) | (64 if woven else 0)) + own + b"\x08")
        coded = lzw_encode(rows.tobytes(), 8)
        parts += [bytes([len(coded[i : i + 255])]) + coded[i : i + 255] for i in range(0, len(coded), 255)] + [b"\0"]
    loop = b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0" if loops is not None else b""
    return (b"GIF89a" if later else b"GIF87a") + struct.pack("<HHBBB", w, h, screen, 0, 0) + (common or b"") + loop + b"".join(parts) + b"\x3b"


def encode(image: Raster, interlace: bool | None = None, loops: int | None = None, disposal: int | None = None, transparency: bool = True, color_table: int = 1, animated: bool = True) -> bytes:
    image.validate()
    return encode_frames([Frame(image, (0, 0, image.width, image.height))], image.width, image.height, loops, interlace, disposal, transparency, color_table)


def renders(seq: Sequence, disposal: int | None = None) -> list[np.ndarray]:
    """What the canvas shows at each frame, as RGBA. Frames of source rectangles are laid over it where they are
    opaque, after one with disposal 2 has cleared its own rectangle; whole canvases replace it."""
    canvas, out, clear = np.zeros((seq.height, seq.width, 4), np.uint8), [], None
    for f in seq.frames:
        if clear is not None:
            canvas[clear] = 0
        clear = None
        if seq.layout == "SourceRect":
            x, y, w, h = f.rect
            box = (slice(y, y + h), slice(x, x + w))
            rgba = f.image.rgba()
            canvas[box] = np.where(rgba[:, :, 3:] > 0, rgba, canvas[box])
            clear = box if (f.disposal if disposal is None else disposal) == 2 else None
        else:
            canvas[:] = f.image.rgba()
        out.append(canvas.copy())
    return out


def coalesce(seq: Sequence, disposal: int | None = None) -> list[Frame]:
    """Frames that show what the one before shows become one with it, their durations added.

    Frames of whole canvases after the first are cut to the box that holds what changes."""
    from math import gcd

    out: list[Frame] = []
    before = None
    for f, shown in zip(seq.frames, renders(seq, disposal), strict=True):
        if before is not None and np.array_equal(shown, before):
            (n1, d1), (n2, d2) = out[-1].duration or (0, 1), f.duration or (0, 1)
            g = gcd(d1, d2)
            out[-1].duration = (n1 * (d2 // g) + n2 * (d1 // g), d1 * (d2 // g))
            continue
        image, rect = f.image, f.rect
        if seq.layout != "SourceRect" and before is not None and image.mode in ("L8", "P8", "Rgb8") and not image.palette_alpha:
            ys, xs = np.nonzero((shown != before).any(axis=2))
            y, x, y2, x2 = int(ys.min()), int(xs.min()), int(ys.max()) + 1, int(xs.max()) + 1
            cut = np.ascontiguousarray(image.array()[y:y2, x:x2])
            image, rect = Raster(x2 - x, y2 - y, image.mode, cut.tobytes(), image.palette), (x, y, x2 - x, y2 - y)
        out.append(Frame(image, rect, f.duration, f.disposal, f.blend, f.interlaced))
        before = shown
    return out


def encode_sequence(seq: Sequence, interlace: bool | None = None, loops: int | None = None, disposal: int | None = None, transparency: bool = True, color_table: int = 1, animated: bool = True) -> bytes:
    """Without `animated` the first frame alone. loops: instead of the sequence's own."""
    frames = coalesce(seq, disposal) if animated else seq.frames[:1]
    return encode_frames(frames, seq.width, seq.height, seq.loops if loops is None else loops, interlace, disposal, transparency, color_table)
