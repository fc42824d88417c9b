"""WebP: container, lossless (VP8L) decoding and encoding, lossy decoding with alpha chunks, animation."""

from __future__ import annotations

import os
import struct

import numpy as np

from rasterloom.functions.codecs import vp8
from rasterloom.functions.codecs.base import CodecError, Frame, Info, NeedMore, Raster, Result, Sequence, check_pixels, malformed, unsupported

# Order in which lengths of code-length codes are stored, and sizes of the five alphabets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABET = (256 + 24, 256, 256, 256, 40)


def near_distances() -> list[tuple[int, int]]:
    """Neighbours above and to the left by rising distance, equal ones by column, right before left: 120 in all."""
    cells = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    cells.sort(key=lambda c: (c[0] * c[0] + c[1] * c[1], abs(c[0]), -c[0]))
    return cells


NEAR = near_distances()


def chunks(data: bytes) -> tuple[list[tuple[bytes, int, int]], int]:
    """[(kind, payload offset, size)] and where the container ends."""
    if len(data) < 12:
        raise NeedMore(12, 0, "webp_header") if b"RIFF".startswith(data[:4]) else malformed("no WebP signature", 0, "webp_header")
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise malformed("no WebP signature", 0, "webp_header")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    end += end % 2
    out, at = [], 12
    while at + 8 <= min(end, len(data)):
        n = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > len(data):
            raise NeedMore(at + 8 + n, at, "webp_chunk")
        out.append((data[at : at + 4], at + 8, n))
        at += 8 + n + n % 2
    if not out:
        raise NeedMore(20, 12, "webp_chunk")
    return out, min(max(end, at), len(data))


def vp8l_header(b: bytes) -> tuple[int, int, bool]:
    if len(b) < 5 or b[0] != 0x2F:
        raise malformed("no lossless signature", None, "webp_bitstream")
    v = struct.unpack_from("<I", b, 1)[0]
    if v >> 29:
        raise malformed("unknown lossless version", None, "webp_bitstream")
    return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, bool(v >> 28 & 1)


def vp8_header(b: bytes) -> tuple[int, int]:
    if len(b) < 10 or b[0] & 1 or b[3:6] != b"\x9d\x01\x2a":
        raise malformed("no key frame", None, "webp_bitstream")
    return struct.unpack_from("<H", b, 6)[0] & 0x3FFF, struct.unpack_from("<H", b, 8)[0] & 0x3FFF


def inspect(data: bytes) -> Info:
    parts, _ = chunks(data)
    kind, at, n = parts[0]
    if kind == b"VP8L":
        w, h, alpha = vp8l_header(data[at : at + n])
        return Info(w, h, "Rgba8" if alpha else "Rgb8")
    if kind == b"VP8 ":
        w, h = vp8_header(data[at : at + n])
        return Info(w, h, "Rgb8")
    if kind != b"VP8X" or n < 10:
        raise malformed("no image chunk", 12, "webp_chunk")
    flags = data[at]
    w, h = int.from_bytes(data[at + 4 : at + 7], "little") + 1, int.from_bytes(data[at + 7 : at + 10], "little") + 1
    check_pixels(w, h)
    frames = sum(k == b"ANMF" for k, *_ in parts) if flags & 2 else 1
    return Info(w, h, "Rgba8" if flags & 16 else "Rgb8", 8, max(frames, 1), bool(flags & 2))


def inspect_basic(data: bytes) -> Info:
    """From the first chunk alone; frames of an animation aren't counted (0)."""
    if len(data) >= 30 and data[12:16] == b"VP8X" and data[20] & 2:
        w, h = int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        check_pixels(w, h)
        return Info(w, h, "Rgba8" if data[20] & 16 else "Rgb8", 8, 0, True)
    return inspect(data)


class _Bits:
    def __init__(self, data: bytes):
        self.v, self.n, self.at, self.data = 0, 0, 0, data

    def need(self, k: int) -> None:
        while self.n < k:
            chunk = self.data[self.at : self.at + 8]
            if not chunk and self.at > len(self.data) + 16:
                raise malformed("the lossless stream ends early", None, "webp_bitstream")
            self.v |= int.from_bytes(chunk, "little") << self.n
            self.at += 8
            self.n += 64

    def read(self, k: int) -> int:
        if not k:
            return 0
        self.need(k)
        out = self.v & ((1 << k) - 1)
        self.v >>= k
        self.n -= k
        return out


class _Code:
    """A canonical prefix code of up to 15 bits, looked up by the next 15."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise malformed("an empty prefix code", None, "webp_bitstream")
        self.one = used[0][1] if len(used) == 1 else None
        if self.one is not None:
            return
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise malformed("a prefix code isn't complete", None, "webp_bitstream")
        self.look: list = [None] * 32768
        code = last = 0
        for n, s in sorted(used):
            code <<= n - last
            last = n
            first = int(f"{code:0{n}b}"[::-1], 2)
            self.look[first :: 1 << n] = [(n, s)] * (1 << (15 - n))
            code += 1

    def read(self, bits: _Bits) -> int:
        if self.one is not None:
            return self.one
        bits.need(15)
        n, s = self.look[bits.v & 0x7FFF]
        bits.v >>= n
        bits.n -= n
        return s


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if first >= size:
            raise malformed("a symbol is out of range", None, "webp_bitstream")
        lengths[first] = 1
        if two:
            second = bits.read(8)
            if second >= size:
                raise malformed("a symbol is out of range", None, "webp_bitstream")
            lengths[second] = 1
        return _Code(lengths)
    own = [0] * 19
    for i in range(bits.read(4) + 4):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = _Code(own)
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > size:
            raise malformed("too many code lengths", None, "webp_bitstream")
    at, before = 0, 8
    while at < size and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        v = before if s == 16 else 0
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + n > size:
            raise malformed("a run of code lengths is too long", None, "webp_bitstream")
        lengths[at : at + n] = [v] * n
        at += n
    return _Code(lengths)


def _value(prefix: int, bits: _Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: _Bits, w: int, h: int, top: bool) -> np.ndarray:
    """w * h ARGB values of an entropy-coded image."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise malformed("colour cache size", None, "webp_bitstream")
    meta, step, groups = None, 0, 1
    if top and bits.read(1):
        step = bits.read(3) + 2
        mw = -(-w // (1 << step))
        meta = (_pixels(bits, mw, -(-h // (1 << step)), False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    codes = [[_read_code(bits, n + ((1 << cache_bits) if i == 0 and cache_bits else 0)) for i, n in enumerate(ALPHABET)] for _ in range(groups)]
    out = [0] * (w * h)
    cache, shift = [0] * (1 << cache_bits) if cache_bits else [], 32 - cache_bits
    at, total, seen = 0, w * h, 0
    while at < total:
        g = codes[meta[(at // w >> step) * mw + (at % w >> step)]] if meta else codes[0]
        s = g[0].read(bits)
        if s < 256:
            r = g[1].read(bits)
            b = g[2].read(bits)
            out[at] = g[3].read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _value(s - 256, bits)
            d = _value(g[4].read(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * w)
            if d > at:
                raise malformed("a copy starts before the image", None, "webp_bitstream")
            n = min(n, total - at)
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            if cache_bits:
                for v in out[seen:at]:
                    cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = v
                seen = at
            if s - 280 >= len(cache):
                raise malformed("a colour isn't in the cache", None, "webp_bitstream")
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.int64)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _guess(mode: int, left, up, corner, right):
    if mode == 0:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, up, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), up)
    if mode <= 9:
        a, b = ((left, corner), (left, up), (corner, up), (up, right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, corner), _average(up, right))
    if mode == 11:
        to_left = sum(abs(u - c) for u, c in zip(up, corner, strict=True))
        to_up = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_up else up
    if mode == 12:
        return [_clamp(x + u - c) for x, u, c in zip(left, up, corner, strict=True)]
    mean = _average(left, up)
    return [_clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def _unpredict(px: np.ndarray, w: int, h: int, step: int, modes: list[int]) -> np.ndarray:
    rows = np.stack([px >> 24 & 255, px >> 16 & 255, px >> 8 & 255, px & 255], axis=-1).reshape(h, w, 4).tolist()
    mw = -(-w // (1 << step))
    for y in range(h):
        row, above = rows[y], rows[y - 1] if y else None
        for x in range(w):
            if not y:
                p = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                p = above[0]
            else:
                mode = modes[(y >> step) * mw + (x >> step)] & 15
                p = _guess(mode if mode < 14 else 0, row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < w else row[0])
            row[x] = [(v + q) & 255 for v, q in zip(row[x], p, strict=True)]
    a = np.array(rows, np.int64).reshape(-1, 4)
    return a[:, 0] << 24 | a[:, 1] << 16 | a[:, 2] << 8 | a[:, 3]


def vp8l_pixels(bits: _Bits, w: int, h: int) -> np.ndarray:
    """(h, w, 4) RGBA bytes of the stream after its header."""
    todo, seen, cw = [], set(), w
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise malformed("a transform comes twice", None, "webp_bitstream")
        seen.add(kind)
        if kind in (0, 1):
            step = bits.read(3) + 2
            todo.append((kind, cw, step, _pixels(bits, -(-cw // (1 << step)), -(-h // (1 << step)), False)))
        elif kind == 2:
            todo.append((2, cw, 0, None))
        else:
            n = bits.read(8) + 1
            raw = _pixels(bits, n, 1, False)
            parts = np.stack([raw >> s & 255 for s in (24, 16, 8, 0)], axis=-1)
            parts = np.cumsum(parts, axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((3, cw, pack, parts[:, 0] << 24 | parts[:, 1] << 16 | parts[:, 2] << 8 | parts[:, 3]))
            cw = -(-cw // (1 << pack))
    px = _pixels(bits, cw, h, True)
    for kind, width, step, table in reversed(todo):
        if kind == 0:
            px = _unpredict(px, width, h, step, (table >> 8 & 255).tolist())
        elif kind == 1:
            mw = -(-width // (1 << step))
            y, x = np.divmod(np.arange(width * h), width)
            m = table[(y >> step) * mw + (x >> step)]
            i8 = lambda v: np.where(v >= 128, v - 256, v)
            g = i8(px >> 8 & 255)
            r = (px >> 16 & 255) + (i8(m & 255) * g >> 5) & 255
            b = (px & 255) + (i8(m >> 8 & 255) * g >> 5) + (i8(m >> 16 & 255) * i8(r) >> 5) & 255
            px = px & 0xFF00FF00 | r << 16 | b
        elif kind == 2:
            g = px >> 8 & 255
            px = px & 0xFF00FF00 | ((px >> 16) + g & 255) << 16 | px + g & 255
        else:
            index = px >> 8 & 255
            if step:
                per, depth = 1 << step, 8 >> step
                index = (index.reshape(h, -1, 1) >> np.arange(0, 8, depth) & ((1 << depth) - 1)).reshape(h, -1)[:, :width].ravel()
                assert per * depth == 8
            full = np.zeros(256, np.int64)
            full[: len(table)] = table
            px = full[index]
    return np.stack([px >> 16 & 255, px >> 8 & 255, px & 255, px >> 24 & 255], axis=-1).astype(np.uint8).reshape(h, w, 4)


def _lossless(b: bytes) -> tuple[np.ndarray, bool]:
    w, h, alpha = vp8l_header(b)
    check_pixels(w, h)
    return vp8l_pixels(_Bits(b[5:]), w, h), alpha


#: Environment variable of executors that names the file of VP8 tables (see vp8.load_tables).
TABLES = "WEBP_TABLES"


def alpha_plane(b: bytes, w: int, h: int) -> np.ndarray:
    """The samples of an alpha chunk: stored, or green of a lossless image without header, then unfiltered."""
    if not b or b[0] & 3 > 1 or b[0] >> 4 & 3 > 1:
        raise malformed("an unknown kind of alpha", None, "webp_chunk")
    if b[0] & 3:
        a = vp8l_pixels(_Bits(b[1:]), w, h)[:, :, 1].copy()
    else:
        if len(b) - 1 < w * h:
            raise malformed("alpha samples end early", None, "webp_chunk")
        a = np.frombuffer(b, np.uint8, w * h, 1).reshape(h, w).copy()
    return unfilter_alpha(a, b[0] >> 2 & 3)


def unfilter_alpha(a: np.ndarray, method: int) -> np.ndarray:
    """Add each sample's prediction: the one to the left, above, or their sum less the corner, cut to a byte.

    The first sample stands for itself; the rest of the first row goes by the left, the first column by the one above."""
    if not method:
        return a
    if method in (1, 2):
        first = np.cumsum(a[0] if method == 2 else a[:, 0], dtype=np.uint8)
        if method == 2:
            a[0] = first
            return np.cumsum(a, axis=0, dtype=np.uint8)
        a[:, 0] = first
        return np.cumsum(a, axis=1, dtype=np.uint8)
    rows = a.tolist()
    for y, row in enumerate(rows):
        up = rows[y - 1]
        for x in range(len(row)):
            if x and y:
                guess = min(max(row[x - 1] + up[x] - up[x - 1], 0), 255)
            else:
                guess = row[x - 1] if x else up[0] if y else 0
            row[x] = row[x] + guess & 255
    return np.array(rows, np.uint8)


def _image(data: bytes, parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, bool]:
    alpha = None
    for kind, at, n in parts:
        if kind == b"VP8L":
            return _lossless(data[at : at + n])
        if kind == b"ALPH":
            alpha = data[at : at + n]
        if kind == b"VP8 ":
            path = os.environ.get(TABLES)
            if not path:
                raise unsupported(f"lossy WebP pixels need the format's probability tables: {TABLES} names none", at, "webp_bitstream")
            rgb = vp8.decode(data[at : at + n], vp8.load_tables(path))
            a = np.full(rgb.shape[:2], 255, np.uint8) if alpha is None else alpha_plane(alpha, rgb.shape[1], rgb.shape[0])
            return np.dstack([rgb, a]), alpha is not None
    raise malformed("no image chunk", 12, "webp_chunk")


def _raster(rgba: np.ndarray, alpha: bool) -> Raster:
    h, w, _ = rgba.shape
    return Raster(w, h, "Rgba8", rgba.tobytes(), alpha="Straight") if alpha else Raster(w, h, "Rgb8", np.ascontiguousarray(rgba[:, :, :3]).tobytes())


def decode(data: bytes) -> Result:
    info = inspect(data)
    if info.animated:
        r = decode_sequence(data)
        return Result(r.value.frames[0].image, r.consumed)
    parts, end = chunks(data)
    rgba, alpha = _image(data, parts)
    image = _raster(rgba, alpha)
    image.metadata = [(k, data[a : a + n]) for k, a, n in parts if k in (b"ICCP", b"EXIF", b"XMP ")]
    return Result(image, end)


def blend(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Straight-alpha RGBA over RGBA in the format's integer arithmetic."""
    s, d = over.astype(np.uint64), under.astype(np.uint64)
    sa, da = s[..., 3:], d[..., 3:]
    f = da * (256 - sa) >> np.uint64(8)
    a = sa + f
    scale = np.uint64(1 << 24) // np.maximum(a, 1)
    mixed = ((s[..., :3] * sa + d[..., :3] * f) * scale & np.uint64(0xFFFFFFFF)) >> np.uint64(24)
    out = np.concatenate([mixed, a], axis=-1)
    out = np.where((da == 0) | (sa == 255), s, out)
    return np.where(sa == 0, d, out).astype(np.uint8)


def decode_sequence(data: bytes) -> Result:
    info = inspect(data)
    if not info.animated:
        r = decode(data)
        return Result(Sequence(info.width, info.height, [Frame(r.value, (0, 0, info.width, info.height))], "SingleFrame", "Canvas"), r.consumed)
    parts, end = chunks(data)
    canvas = np.zeros((info.height, info.width, 4), np.uint8)
    frames, loops, clear = [], None, None
    for kind, at, n in parts:
        if kind == b"ANIM" and n >= 6:
            loops = struct.unpack_from("<H", data, at + 4)[0]
        if kind != b"ANMF" or n < 16:
            continue
        u24 = lambda i: int.from_bytes(data[at + i : at + i + 3], "little")  # noqa: B023, E731
        x, y, w, h, ms, flags = 2 * u24(0), 2 * u24(3), u24(6) + 1, u24(9) + 1, u24(12), data[at + 15]
        if x + w > info.width or y + h > info.height:
            raise malformed("a frame is outside its canvas", at, "webp_chunk")
        inner, pos = [], at + 16
        while pos + 8 <= at + n:
            k = struct.unpack_from("<I", data, pos + 4)[0]
            inner.append((data[pos : pos + 4], pos + 8, k))
            pos += 8 + k + k % 2
        rgba, _ = _image(data, inner)
        if rgba.shape[:2] != (h, w):
            raise malformed("a frame has another size", at, "webp_chunk")
        if clear is not None:
            canvas[clear] = 0
        box = (slice(y, y + h), slice(x, x + w))
        canvas[box] = rgba if flags & 2 else blend(rgba, canvas[box])
        clear = box if flags & 1 else None
        frames.append(Frame(_raster(canvas.copy(), info.mode == "Rgba8"), (x, y, w, h), (ms, 1000), flags & 1, "Source" if flags & 2 else "Over"))
    if not frames:
        raise malformed("no frames", 12, "webp_chunk")
    return Result(Sequence(info.width, info.height, frames, "TimedAnimation", "Canvas", loops), end)


def verify(data: bytes) -> None:
    inspect(data)


def metadata_bytes(data: bytes) -> int:
    parts, end = chunks(data)
    return end - sum(n for k, _, n in parts if k in (b"VP8 ", b"VP8L", b"ALPH"))


class _Writer:
    """Values of some bits each, low bits first, packed in one step at the end."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, v: int, k: int) -> None:
        self.extend(np.array([v]), np.array([k]))

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values.astype(np.int64))
        self.sizes.append(sizes.astype(np.int64))

    def done(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        item = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.packbits((values[item] >> place & 1).astype(np.uint8), bitorder="little").tobytes()


def _lengths(counts: np.ndarray, limit: int = 15) -> list[int]:
    """Lengths of a complete prefix code within the limit; flatter counts are tried until they fit."""
    import heapq

    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        used = sorted({*used, 0, 1})[:2] if used and used[0] in (0, 1) else sorted({*used, 0})[:2]
        out = [0] * len(counts)
        for s in used:
            out[s] = 1
        return out
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), s, (s,)) for s in used]
        depth = dict.fromkeys(used, 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= limit:
            return [depth.get(s, 0) for s in range(len(counts))]
        floor = max(2 * floor, int(counts.max()) >> limit)


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def _write_code(out: _Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    out.put(0, 1)
    counts = np.bincount(lengths, minlength=19)
    own = _lengths(counts, 7)
    n = max(i for i in range(19) if own[LENGTH_ORDER[i]]) + 1
    n = max(n, 4)
    out.put(n - 4, 4)
    for i in range(n):
        out.put(own[LENGTH_ORDER[i]], 3)
    out.put(0, 1)
    codes = _codes(own)
    for x in lengths:
        out.put(*codes[x])
    return _codes(lengths)


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distances of 1 or more."""
    n = v - 1
    high = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    extra = np.where(n < 4, 0, high - 1)
    symbol = np.where(n < 4, n, 2 * high + (n >> np.maximum(high - 1, 0) & 1))
    return symbol, n & (1 << extra) - 1, extra


LEAST_RUN, MOST_RUN = 4, 4096


def _write_pixels(out: _Writer, argb: np.ndarray, top: bool) -> None:
    """An entropy-coded image: literals, and runs of one colour as copies from the pixel before."""
    out.put(0, 1)
    if top:
        out.put(0, 1)
    n = len(argb)
    same = np.r_[False, argb[1:] == argb[:-1]] if n else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    begin, length = edge[0::2], edge[1::2] - edge[0::2]
    begin, length = begin[length >= LEAST_RUN], length[length >= LEAST_RUN]
    pieces = -(-length // MOST_RUN)
    which = np.repeat(np.arange(len(begin)), pieces)
    part = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, size = begin[which] + part * MOST_RUN, np.minimum(length[which] - part * MOST_RUN, MOST_RUN)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + length, -1)
    literal = np.flatnonzero(np.cumsum(covered[:n]) == 0)
    v = argb[literal]
    symbol, extra, bits = _prefix(size)
    green = np.concatenate([v >> 8 & 255, 256 + symbol])
    channels = [green, v >> 16 & 255, v & 255, v >> 24 & 255, np.full(len(at), 1)]  # distance 2 of the near ones: one to the left
    codes = [_write_code(out, _lengths(np.bincount(c, minlength=k))) for c, k in zip(channels, ALPHABET, strict=True)]
    tables = []
    for c, k in zip(codes, ALPHABET, strict=True):
        t = np.zeros((k, 2), np.int64)
        for s, code in c.items():
            t[s] = code
        tables.append(t)
    rows = np.zeros((len(literal) + len(at), 4, 2), np.int64)
    for i, c in enumerate(channels[:4]):
        rows[: len(literal), i] = tables[i][c[: len(literal)]]
    rows[len(literal) :, 0] = tables[0][256 + symbol]
    rows[len(literal) :, 1] = np.stack([extra, bits], axis=1)
    rows[len(literal) :, 2] = tables[4][channels[4]]
    rows = rows[np.argsort(np.concatenate([literal, at]), kind="stable")]
    out.extend(rows[:, :, 0].ravel(), rows[:, :, 1].ravel())


def _guesses(px: np.ndarray) -> dict[int, np.ndarray]:
    """Predictions of each pixel (h, w, 4) by the modes that need no pixel to the right."""
    h, w, _ = px.shape
    p = px.astype(np.int16)
    left, up, corner = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    left[:, 1:], up[1:], corner[1:, 1:] = p[:, :-1], p[:-1], p[:-1, :-1]
    nearer = (np.abs(up - corner).sum(axis=2) < np.abs(left - corner).sum(axis=2))[:, :, None]
    mean = left + up >> 1
    half = mean - corner
    out = {1: left, 2: up, 7: mean, 11: np.where(nearer, left, up), 12: np.clip(left + up - corner, 0, 255), 13: np.clip(mean + (half + (half < 0) >> 1), 0, 255)}
    for g in out.values():
        g[0, 1:], g[1:, 0], g[0, 0] = left[0, 1:], up[1:, 0], (255, 0, 0, 0)
    return out


def _cost(residual: np.ndarray) -> float:
    """Bits that the channels' values take at their entropies."""
    total = 0.0
    for c in range(4):
        n = np.bincount(residual[:, :, c].ravel(), minlength=256)
        n = n[n > 0]
        total += float((n * np.log2(n.sum() / n)).sum())
    return total


def encode_vp8l(rgba: np.ndarray) -> bytes:
    """Lossless: subtract-green, one predictor for the whole image where it pays, and runs as copies."""
    h, w, _ = rgba.shape
    if w > 16384 or h > 16384:
        raise CodecError("Dimensions", "a WebP has at most 16384 pixels a side")
    out = _Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((rgba[:, :, 3] != 255).any()), 1)
    out.put(0, 3)
    out.put(1, 1)
    out.put(2, 2)
    px = rgba[:, :, [3, 0, 1, 2]].copy()
    px[:, :, 1] -= px[:, :, 2]
    px[:, :, 3] -= px[:, :, 2]
    tried = {m: (px - g.astype(np.uint8)) for m, g in _guesses(px).items()}
    costs = {m: _cost(r) for m, r in tried.items()}
    best = min(costs, key=lambda m: (costs[m], m))
    if costs[best] < _cost(px):
        out.put(1, 1)
        out.put(0, 2)
        out.put(7, 3)  # blocks of 512 pixels a side
        _write_pixels(out, np.full(-(-w // 512) * -(-h // 512), 255 << 24 | best << 8, np.int64), False)
        px = tried[best]
    out.put(0, 1)
    v = px.astype(np.int64)
    _write_pixels(out, (v[:, :, 0] << 24 | v[:, :, 1] << 16 | v[:, :, 2] << 8 | v[:, :, 3]).ravel(), True)
    return out.done()


def riff(parts: list[tuple[bytes, bytes]]) -> bytes:
    body = b"".join(k + struct.pack("<I", len(p)) + p + b"\0" * (len(p) % 2) for k, p in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def encode(image: Raster) -> bytes:
    """Lossless only; lossy encoding isn't there."""
    image.validate()
    return riff([(b"VP8L", encode_vp8l(image.rgba()))])


def encode_sequence(seq: Sequence) -> bytes:
    """Whole canvases, each replacing the one before."""
    frames = []
    for f in seq.frames:
        num, den = f.duration or (0, 1)
        if num * 1000 % den or num * 1000 // den >= 1 << 24:
            raise CodecError("Parameter", "a duration must be whole milliseconds below 2**24")
        if (f.image.width, f.image.height) != (seq.width, seq.height):
            raise CodecError("Parameter", "frames must be whole canvases")
        u24 = lambda v: v.to_bytes(3, "little")
        body = encode_vp8l(f.image.rgba())
        frames.append((b"ANMF", u24(0) + u24(0) + u24(seq.width - 1) + u24(seq.height - 1) + u24(num * 1000 // den) + b"\x02" + b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)))
    alpha = any(f.image.mode in ("Rgba8", "La8") or f.image.palette_alpha for f in seq.frames)
    head = bytes([2 | 16 * alpha, 0, 0, 0]) + (seq.width - 1).to_bytes(3, "little") + (seq.height - 1).to_bytes(3, "little")
    return riff([(b"VP8X", head), (b"ANIM", bytes(4) + struct.pack("<H", seq.loops or 0)), *frames])
