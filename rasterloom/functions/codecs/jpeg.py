"""JPEG: baseline and progressive decoding, baseline encoding."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from rasterloom.functions.codecs.base import CodecError, Info, NeedMore, Raster, Result, check_pixels, malformed, unsupported
from rasterloom.operators.jpegmath import CHROMINANCE, LUMINANCE, zigzag

ZIGZAG = np.array(zigzag())
# The standard's typical Huffman tables, code counts by length and then symbols.
# fmt: off
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    (
        1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177,
        193, 21, 82, 209, 240, 36, 51, 98, 114, 130, 9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40, 41, 42, 52, 53, 54, 55,
        56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105, 106,
        115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163,
        164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211,
        212, 213, 214, 215, 216, 217, 218, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248, 249, 250,
    ),
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    (
        0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113, 19, 34, 50, 129, 8, 20, 66, 145, 161, 177, 193,
        9, 35, 51, 82, 240, 21, 98, 114, 209, 10, 22, 36, 52, 225, 37, 241, 23, 24, 25, 26, 38, 39, 40, 41, 42, 53, 54,
        55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105,
        106, 115, 116, 117, 118, 119, 120, 121, 122, 130, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154,
        162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202,
        210, 211, 212, 213, 214, 215, 216, 217, 218, 226, 227, 228, 229, 230, 231, 232, 233, 234, 242, 243, 244, 245, 246, 247, 248, 249, 250,
    ),
)

# fmt: on
# The constants of the integer transform, in 13 bits.
BITS13 = {c: round(c * 8192) for c in (0.298631336, 0.390180644, 0.541196100, 0.765366865, 0.899976223, 1.175875602, 1.501321110, 1.847759065, 1.961570560, 2.053119869, 2.562915447, 3.072711026)}


def _transform() -> np.ndarray:
    """The 8 x 8 integer matrix from coefficients to samples that the constants make, in units of 1 / 8192.

    The transform's sums of products are exact, so it is one matrix; only the shifts after each pass round.
    Samples 7 to 4 mirror 0 to 3: even coefficients alike, odd ones with the other sign."""
    k = [BITS13[c] for c in sorted(BITS13)]
    even = np.array([[8192, k[2] + k[3], 8192, k[2]], [8192, k[2], -8192, k[2] - k[7]], [8192, -k[2], -8192, k[7] - k[2]], [8192, -k[2] - k[3], 8192, -k[2]]])
    odd = np.full((4, 4), k[5])  # coefficients 1, 3, 5, 7
    for sample, own in enumerate((k[6], k[11], k[9], k[0])):
        odd[sample, sample] += own
        pair = (0, 3) if sample in (0, 3) else (1, 2)
        far = (0, 2) if sample in (0, 2) else (1, 3)
        odd[sample, list(pair)] -= k[4] if sample in (0, 3) else k[10]
        odd[sample, list(far)] -= k[1] if sample in (0, 2) else k[8]
    half = np.zeros((4, 8), np.int64)
    half[:, 0::2], half[:, 1::2] = even, odd
    return np.concatenate([half, half[::-1] * np.array([1, -1] * 4)])


TRANSFORM = _transform()
_EXACT = TRANSFORM.astype(np.float64)  # products stay below 2 ** 53, so doubles are exact and fast


def _descale(x: np.ndarray, bits: int) -> np.ndarray:
    return np.floor((x + (1 << (bits - 1))) / (1 << bits))


def inverse_dct(c: np.ndarray) -> np.ndarray:
    """Blocks (n, 8, 8) of dequantised coefficients to samples: columns, then rows, in fixed point."""
    columns = _descale(_EXACT @ c, 11)
    return np.clip(_descale(columns @ _EXACT.T, 18) + 128, 0, 255).astype(np.uint8)


def forward_dct(s: np.ndarray) -> np.ndarray:
    """Blocks of samples to 8 times their coefficients: rows, then columns, in fixed point."""
    rows = _descale((s - 128.0) @ _EXACT, 11)
    return _descale(_EXACT.T @ rows, 15)


def canonical(counts: tuple, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)"""
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _look(counts: tuple, symbols: bytes) -> list[int]:
    """By the next 16 bits: 32 * symbol + length of its code, or -1."""
    look = np.full(65536, -1, np.int64)
    for s, (code, n) in canonical(counts, symbols).items():
        lo = code << (16 - n)
        look[lo : lo + (1 << (16 - n))] = s << 5 | n
    return look.tolist()


class _Bits:
    """Entropy-coded bits of one segment without its stuffed zeros; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") + b"\0\0\0\0"
        self.acc, self.n, self.at = 0, 0, 0

    def peek16(self) -> int:
        while self.n < 16:
            b = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.acc = (self.acc << 8 | b) & 0xFFFFFFFF
            self.n += 8
        return self.acc >> (self.n - 16) & 0xFFFF

    def symbol(self, look: list[int]) -> int:
        e = look[self.peek16()]
        if e < 0:
            raise malformed("a code has no symbol", None, "jpeg_segment")
        self.n -= e & 31
        return e >> 5

    def bits(self, k: int) -> int:
        if not k:
            return 0
        if k > 16:
            raise malformed(f"a value of {k} bits", None, "jpeg_segment")
        v = self.peek16() >> (16 - k)
        self.n -= k
        return v

    def signed(self, k: int) -> int:
        v = self.bits(k)
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


class _Component:
    def __init__(self, name: int, h: int, v: int, tq: int):
        self.name, self.h, self.v, self.tq = name, h, v, tq
        self.td = self.ta = self.pred = 0


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from `at`, cut at restart markers, and the place of the marker that ends them."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[start:])
            return out, len(data)
        m = data[at + 1]
        if m == 0 or m == 255:
            at += 1 + (m == 0)
        elif 0xD0 <= m <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        else:
            out.append(data[start:at])
            return out, at


class _Decoder:
    def __init__(self, data: bytes, header_only: bool = False):
        self.data, self.quant, self.dc, self.ac = data, {}, {}, {}
        self.parts: list[_Component] = []
        self.restart = self.entropy = 0
        self.adobe = None
        self.metadata: list[tuple[bytes, bytes]] = []
        self.w = self.h = 0
        self.progressive = False
        self.end = len(data)
        self.scans = 0
        self._parse(header_only)

    def _parse(self, header_only: bool) -> None:
        d = self.data
        if len(d) < 3:
            raise NeedMore(3, 0, "jpeg_marker") if b"\xff\xd8\xff".startswith(d) else malformed("no JPEG signature", 0, "jpeg_marker")
        if d[:3] != b"\xff\xd8\xff":
            raise malformed("no JPEG signature", 0, "jpeg_marker")
        at = 2
        while True:
            while at < len(d) and d[at] != 255:
                at += 1
            while at + 1 < len(d) and d[at + 1] == 255:
                at += 1
            if at + 1 >= len(d):
                if self.scans:
                    return
                raise NeedMore(len(d) + 1, at, "jpeg_marker")
            m, at = d[at + 1], at + 2
            if m == 0xD9:
                self.end = at
                if not self.scans:
                    raise malformed("no scan", at - 2, "jpeg_marker")
                return
            if m == 0x01 or 0xD0 <= m <= 0xD8:
                continue
            if at + 2 > len(d):
                raise NeedMore(at + 2, at, "jpeg_segment")
            n = struct.unpack_from(">H", d, at)[0]
            if n < 2:
                raise malformed("a segment is too short", at, "jpeg_segment")
            if at + n > len(d):
                raise NeedMore(at + n, at, "jpeg_segment")
            body, here = d[at + 2 : at + n], at
            at += n
            if m in (0xC0, 0xC1, 0xC2):
                self._frame(body, here, m == 0xC2)
                if header_only:
                    return
            elif 0xC3 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
                raise unsupported(f"frame type {m:#x}", here, "jpeg_sof")
            elif m == 0xDB:
                self._quant(body, here)
            elif m == 0xC4:
                self._huffman(body, here)
            elif m == 0xDD:
                if len(body) != 2:
                    raise malformed("DRI has two bytes", here, "jpeg_dri")
                self.restart = struct.unpack(">H", body)[0]
            elif m == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif m == 0xFE or 0xE0 <= m <= 0xEF:
                self.metadata.append((bytes([m]), body))
            elif m == 0xDA:
                at = self._scan(body, here, at)

    def _frame(self, b: bytes, at: int, progressive: bool) -> None:
        if self.parts:
            raise malformed("two frames", at, "jpeg_sof")
        if len(b) < 6 or len(b) < 6 + 3 * b[5]:
            raise malformed("SOF is too short", at, "jpeg_sof")
        bits, self.h, self.w, n = struct.unpack_from(">BHHB", b)
        if bits != 8 or n not in (1, 3, 4):
            raise unsupported(f"{n} components of {bits} bits", at, "jpeg_sof")
        check_pixels(self.w, self.h)
        self.progressive = progressive
        for i in range(n):
            name, hv, tq = b[6 + 3 * i : 9 + 3 * i]
            if not 1 <= hv >> 4 <= 4 or not 1 <= hv & 15 <= 4:
                raise malformed("sampling factors of 1 to 4", at, "jpeg_sof")
            self.parts.append(_Component(name, hv >> 4, hv & 15, tq))
        if n == 1:
            self.parts[0].h = self.parts[0].v = 1
        hm, vm = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.mx, self.my = -(-self.w // (8 * hm)), -(-self.h // (8 * vm))
        for c in self.parts:
            c.width, c.height = -(-self.w * c.h // hm), -(-self.h * c.v // vm)
            c.bw, c.bh = self.mx * c.h, self.my * c.v
            c.coef = np.zeros((c.bh * c.bw, 64), np.int32)

    def _quant(self, b: bytes, here: int) -> None:
        at = 0
        while at < len(b):
            wide, t = b[at] >> 4, b[at] & 15
            n = 128 if wide else 64
            if at + 1 + n > len(b) or t > 3:
                raise malformed("DQT is too short", here, "jpeg_dqt")
            self.quant[t] = np.frombuffer(b, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int32)
            at += 1 + n

    def _huffman(self, b: bytes, here: int) -> None:
        at = 0
        while at < len(b):
            if at + 17 > len(b):
                raise malformed("DHT is too short", here, "jpeg_dht")
            kind, t, counts = b[at] >> 4, b[at] & 15, tuple(b[at + 1 : at + 17])
            n = sum(counts)
            if at + 17 + n > len(b) or kind > 1 or t > 3 or n > 256:
                raise malformed("DHT is wrong", here, "jpeg_dht")
            total = 0
            for i, c in enumerate(counts, 1):
                total += c << (16 - i)
            if total > 65536:
                raise malformed("too many codes", here, "jpeg_dht")
            (self.ac if kind else self.dc)[t] = _look(counts, b[at + 17 : at + 17 + n])
            at += 17 + n

    def _scan(self, b: bytes, here: int, at: int) -> int:
        if not self.parts:
            raise malformed("a scan before its frame", here, "jpeg_sos")
        n = b[0] if b else 0
        if not 1 <= n <= 4 or len(b) < 4 + 2 * n:
            raise malformed("SOS is wrong", here, "jpeg_sos")
        parts = []
        for i in range(n):
            found = [c for c in self.parts if c.name == b[1 + 2 * i]]
            if not found:
                raise malformed("a scan names no component", here, "jpeg_sos")
            found[0].td, found[0].ta = b[2 + 2 * i] >> 4, b[2 + 2 * i] & 15
            parts.append(found[0])
        ss, se, a = b[1 + 2 * n : 4 + 2 * n]
        segments, end = _segments(self.data, at)
        self.entropy += end - at
        self.scans += 1
        units = self._units(parts)
        step = self.restart or len(units)
        try:
            for i, seg in enumerate(segments):
                part = units[i * step : (i + 1) * step]
                if not part:
                    break
                for c in parts:
                    c.pred = 0
                if self.progressive:
                    self._decode_units(_Bits(seg), part, ss, se, a >> 4, a & 15)
                else:
                    self._decode_baseline(seg, part)
        except KeyError as e:
            raise malformed("a scan uses a table that isn't there", here, "jpeg_sos") from e
        return end

    def _units(self, parts: list[_Component]) -> list[list[tuple[_Component, int]]]:
        """The blocks of each unit of a scan: one block, or with several components those of an MCU."""
        if len(parts) == 1:
            c = parts[0]
            bw, bh = -(-c.width // 8), -(-c.height // 8)
            return [[(c, y * c.bw + x)] for y in range(bh) for x in range(bw)]
        return [[(c, (my * c.v + v) * c.bw + mx * c.h + h) for c in parts for v in range(c.v) for h in range(c.h)] for my in range(self.my) for mx in range(self.mx)]

    def _decode_baseline(self, seg: bytes, units: list) -> None:
        """All coefficients of a segment's blocks. The state is held in local names, as this loop runs for each code."""
        data = seg.replace(b"\xff\x00", b"\xff")
        end, zz = len(data) + 64, ZIGZAG.tolist()
        acc = n = at = 0
        places: dict[int, tuple[list, list]] = {id(c): ([], []) for c, _ in units[0]}
        for unit in units:
            if at > end:  # zeros alone from here on
                break
            for c, k in unit:
                where, what = places[id(c)]
                base, i, look = 64 * k, 0, self.dc[c.td]
                while i < 64:
                    if n < 32:
                        word = data[at : at + 4]
                        acc = (acc & (1 << n) - 1) << 32 | int.from_bytes(word, "big") << 8 * (4 - len(word))
                        n += 32
                        at += 4
                    e = look[acc >> n - 16 & 65535]
                    if e < 0:
                        raise malformed("a code has no symbol", None, "jpeg_segment")
                    n -= e & 31
                    s = e >> 5
                    if i:
                        r, s = s >> 4, s & 15
                        if not s:
                            if r < 15:
                                break
                            i += 16
                            continue
                        i += r
                        if i > 63:
                            break
                    elif s > 16:
                        raise malformed(f"a value of {s} bits", None, "jpeg_segment")
                    n -= s
                    v = acc >> n & (1 << s) - 1
                    if s and not v >> s - 1:
                        v -= (1 << s) - 1
                    if i:
                        where.append(base + zz[i])
                        what.append(v)
                    else:
                        c.pred += v
                        where.append(base)
                        what.append(c.pred)
                        look = self.ac[c.ta]
                    i += 1
        for c, _ in units[0]:
            c.coef.ravel()[places[id(c)][0]] = places[id(c)][1]

    def _decode_units(self, bits: _Bits, units: list, ss: int, se: int, high: int, low: int) -> None:
        zz = ZIGZAG.tolist()
        run = 0
        for unit in units:
            if bits.at > len(bits.data) + 64:  # zeros alone from here on
                return
            for c, k in unit:
                row = c.coef[k]
                if ss == 0:
                    if high:
                        row[0] |= bits.bits(1) << low
                    else:
                        c.pred += bits.signed(bits.symbol(self.dc[c.td]))
                        row[0] = c.pred << low
                elif not high:
                    if run:
                        run -= 1
                        continue
                    t, i = self.ac[c.ta], ss
                    while i <= se:
                        rs = bits.symbol(t)
                        r, s = rs >> 4, rs & 15
                        if not s:
                            if r < 15:
                                run = (1 << r) - 1 + bits.bits(r)
                                break
                            i += 16
                            continue
                        i += r
                        if i > 63:
                            break
                        row[zz[i]] = bits.signed(s) << low
                        i += 1
                else:
                    run = self._refine(bits, row, zz, self.ac[c.ta], ss, se, 1 << low, run)

    @staticmethod
    def _refine(bits: _Bits, row: np.ndarray, zz: list, t: list[int], ss: int, se: int, one: int, run: int) -> int:
        """A later bit of each coefficient that is there, and new ones of size one in between."""
        i = ss

        def touch(p: int) -> None:
            if bits.bits(1) and not abs(int(row[p])) & one:
                row[p] += one if row[p] >= 0 else -one

        if not run:
            while i <= se:
                rs = bits.symbol(t)
                r, s = rs >> 4, rs & 15
                value = 0
                if s:
                    value = one if bits.bits(1) else -one
                elif r < 15:
                    run = (1 << r) + bits.bits(r)
                    break
                while i <= se:
                    p = zz[i]
                    if row[p]:
                        touch(p)
                    else:
                        if not r:
                            if value:
                                row[p] = value
                            i += 1
                            break
                        r -= 1
                    i += 1
        if run:
            while i <= se:
                if row[zz[i]]:
                    touch(zz[i])
                i += 1
            run -= 1
        return run

    def planes(self) -> list[np.ndarray]:
        out = []
        hm, vm = max(c.h for c in self.parts), max(c.v for c in self.parts)
        for c in self.parts:
            if c.tq not in self.quant:
                raise malformed("a component's table isn't there", None, "jpeg_dqt")
            q = np.empty(64, np.int32)
            q[ZIGZAG] = self.quant[c.tq]
            blocks = inverse_dct((c.coef * q).reshape(-1, 8, 8).astype(np.float64))
            plane = blocks.reshape(c.bh, c.bw, 8, 8).transpose(0, 2, 1, 3).reshape(c.bh * 8, c.bw * 8)[: c.height, : c.width]
            out.append(upsample(plane, hm // c.h, vm // c.v)[: self.h, : self.w])
        return out


def _h2(a: np.ndarray) -> np.ndarray:
    """Twice as wide: three parts of the near sample, one of the next; ends are copied."""
    v = a.astype(np.int32)
    left, right = np.concatenate([v[:, :1], v[:, :-1]], axis=1), np.concatenate([v[:, 1:], v[:, -1:]], axis=1)
    out = np.empty((len(v), 2 * v.shape[1]), np.int32)
    out[:, 0::2], out[:, 1::2] = (3 * v + left + 1) >> 2, (3 * v + right + 2) >> 2
    out[:, 0], out[:, -1] = v[:, 0], v[:, -1]
    return out.astype(np.uint8)


def _h2v2(a: np.ndarray) -> np.ndarray:
    """Twice as wide and high: 9, 3, 3 and 1 sixteenths of the four nearest samples."""
    v = a.astype(np.int32)
    up, down = np.concatenate([v[:1], v[:-1]]), np.concatenate([v[1:], v[-1:]])
    rows = np.empty((2 * len(v), v.shape[1]), np.int32)
    rows[0::2], rows[1::2] = 3 * v + up, 3 * v + down
    left, right = np.concatenate([rows[:, :1], rows[:, :-1]], axis=1), np.concatenate([rows[:, 1:], rows[:, -1:]], axis=1)
    out = np.empty((len(rows), 2 * rows.shape[1]), np.int32)
    out[:, 0::2], out[:, 1::2] = (3 * rows + left + 8) >> 4, (3 * rows + right + 7) >> 4
    out[:, 0], out[:, -1] = (4 * rows[:, 0] + 8) >> 4, (4 * rows[:, -1] + 7) >> 4
    return out.astype(np.uint8)


def upsample(a: np.ndarray, fx: int, fy: int) -> np.ndarray:
    if (fx, fy) == (1, 1):
        return a
    if a.shape[1] > 2 and fx == 2 and fy in (1, 2):
        return _h2(a) if fy == 1 else _h2v2(a)
    return a.repeat(fy, axis=0).repeat(fx, axis=1)


def ycc_to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y, u, v = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    r, g, b = y + ((91881 * v + 32768) >> 16), y + ((-22554 * u - 46802 * v + 32768) >> 16), y + ((116130 * u + 32768) >> 16)
    return np.clip(np.stack([r, g, b], axis=-1), 0, 255).astype(np.uint8)


def rgb_to_ycc(a: np.ndarray) -> list[np.ndarray]:
    r, g, b = (a[:, :, i].astype(np.int32) for i in range(3))
    bias = (128 << 16) + 32767
    return [(19595 * r + 38470 * g + 7471 * b + 32768) >> 16, (-11059 * r - 21709 * g + 32768 * b + bias) >> 16, (32768 * r - 27439 * g - 5329 * b + bias) >> 16]


def inspect(data: bytes) -> Info:
    d = _Decoder(data, header_only=True)
    return Info(d.w, d.h, {1: "L8", 3: "Rgb8", 4: "Cmyk8"}[len(d.parts)])


def decode(data: bytes) -> Result:
    d = _Decoder(data)
    planes = d.planes()
    if len(planes) == 1:
        image = Raster(d.w, d.h, "L8", planes[0].tobytes())
    elif len(planes) == 3:
        image = Raster(d.w, d.h, "Rgb8", ycc_to_rgb(*planes).tobytes())
    else:
        if d.progressive and d.adobe == 2:
            planes[:3] = [255 - p for p in np.moveaxis(ycc_to_rgb(*planes[:3]), 2, 0)]
        image = Raster(d.w, d.h, "Cmyk8", (255 - np.stack(planes, axis=-1)).tobytes())
    image.metadata = d.metadata
    return Result(image, d.end)


def verify(data: bytes) -> None:
    _Decoder(data, header_only=True)


def metadata_bytes(data: bytes) -> int:
    d = _Decoder(data)
    return d.end - d.entropy


def quant_table(base: tuple, quality: int) -> np.ndarray:
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _down(p: np.ndarray, fx: int, fy: int) -> np.ndarray:
    h, w = p.shape
    p = np.pad(p, ((0, h % fy), (0, w % fx)), mode="edge")
    odd = np.arange(p.shape[1] // fx) & 1
    if fx == 2 and fy == 1:
        return (p[:, 0::2] + p[:, 1::2] + odd) >> 1
    return (p[0::2, 0::2] + p[0::2, 1::2] + p[1::2, 0::2] + p[1::2, 1::2] + 1 + odd) >> 2


def _pad(p: np.ndarray, h: int, w: int) -> np.ndarray:
    return np.pad(p, ((0, h - p.shape[0]), (0, w - p.shape[1])), mode="edge")


class _Writer:
    def __init__(self):
        self.out, self.acc, self.n = bytearray(), 0, 0

    def put(self, v: int, k: int) -> None:
        self.acc, self.n = self.acc << k | v, self.n + k
        while self.n >= 8:
            b = self.acc >> (self.n - 8) & 255
            self.out.append(b)
            if b == 255:
                self.out.append(0)
            self.n -= 8
        self.acc &= (1 << self.n) - 1

    def flush(self) -> None:
        if self.n:
            self.put((1 << (8 - self.n)) - 1, 8 - self.n)


def _in_order(parts: list, mcus: int, mx: int, restart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in the order of the scan, with DC differences, each with its table and its restart segment."""
    n = np.arange(mcus)
    segment = n // restart if restart else np.zeros(mcus, np.int64)
    rows, tables = [], []
    for levels, sx, sy, bw, t in parts:
        v, u = np.divmod(np.arange(sx * sy), sx)
        own = levels[(n[:, None] // mx * sy + v) * bw + n[:, None] % mx * sx + u].reshape(-1, 64).copy()
        of = np.repeat(segment, sx * sy)
        before = np.where(np.r_[True, of[1:] != of[:-1]], 0, np.r_[0, own[:-1, 0]])
        own[:, 0] -= before
        rows.append(own.reshape(mcus, sx * sy, 64))
        tables.append(np.full((mcus, sx * sy), t))
    blocks, tables_of = np.concatenate(rows, axis=1), np.concatenate(tables, axis=1)
    return blocks.reshape(-1, 64), tables_of.ravel(), np.repeat(segment, blocks.shape[1])


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1]


def _events(blocks: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, table, symbol, extra bits, their number) of all codes in order; tables 2 and 3 are the AC ones.

    A block has its DC difference, then for each other coefficient that isn't zero the codes of 16 zeros before
    it and its own, then the end of block where zeros are left."""
    at, k = np.nonzero(blocks[:, 1:])
    k += 1
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    run = k - 1 - np.where(first, 0, np.r_[0, k[:-1]]) if len(at) else k
    value = blocks[at, k]
    size = _bit_length(value)
    zeros = np.repeat(np.arange(len(at)), run >> 4)
    last = np.zeros(len(blocks), np.int64)
    last[at] = k  # the last of each block remains
    ended = np.flatnonzero(last < 63)
    dc = blocks[:, 0]
    extra = lambda v, n: np.where(v > 0, v, v - 1) & ((1 << n) - 1)
    every = np.arange(len(blocks))
    block = np.concatenate([every, at[zeros], at, ended])
    place = np.concatenate([np.zeros(len(every), np.int64), 2 * k[zeros], 2 * k + 1, np.full(len(ended), 200)])
    symbol = np.concatenate([_bit_length(dc), np.full(len(zeros), 0xF0), (run & 15) << 4 | size, np.zeros(len(ended), np.int64)])
    bits = np.concatenate([extra(dc, _bit_length(dc)), np.zeros(len(zeros), np.int64), extra(value, size), np.zeros(len(ended), np.int64)])
    sizes = np.concatenate([_bit_length(dc), np.zeros(len(zeros), np.int64), size, np.zeros(len(ended), np.int64)])
    table = np.concatenate([tables, 2 + tables[at[zeros]], 2 + tables[at], 2 + tables[ended]])
    order = np.argsort(block * 256 + place, kind="stable")
    return block[order], table[order], symbol[order], bits[order], sizes[order]


def _counted(symbols: np.ndarray) -> dict[int, int]:
    n = np.bincount(symbols, minlength=256)
    return {s: int(n[s]) for s in np.flatnonzero(n).tolist()}


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of some bits each end to end, filled up with ones, a zero byte after each byte of ones."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(item))
    bits = (values[item] >> left & 1).astype(np.uint8)
    return np.packbits(np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\x00")


def optimal_table(counts: dict[int, int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Code counts by length (16 at most) and symbols, from frequencies; one code of all ones stays unused."""
    import heapq

    heap = [(n, 256 - s, (s,)) for s, n in counts.items()] + [(0, -1, (-1,))]
    depth = dict.fromkeys([*counts, -1], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    lengths = [0] * 64
    for d in depth.values():
        lengths[max(d, 1)] += 1
    for i in range(63, 16, -1):  # over-long codes: two of them give way to one, and a shorter one is split
        while lengths[i]:
            j = i - 2
            while not lengths[j]:
                j -= 1
            lengths[i] -= 2
            lengths[i - 1] += 1
            lengths[j + 1] += 2
            lengths[j] -= 1
    longest = max(i for i in range(1, 17) if lengths[i])
    lengths[longest] -= 1
    order = sorted(counts, key=lambda s: (depth[s], s))
    return tuple(lengths[1:17]), tuple(order)


SAMPLING = {"4:4:4": (1, 1), "4:2:2": (2, 1), "4:2:0": (2, 2)}


# Scans of a progressive file as (components, first and last coefficient, bit before, bit), in colour and gray.
COLOR_SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0))
GRAY_SCANS = (((0,), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0,), 0, 0, 1, 0), ((0,), 1, 63, 1, 0))


class _Band:
    """Events of one AC scan: (symbol or None, bits, their number), with runs of blocks that end early put together."""

    def __init__(self):
        self.events: list[tuple] = []
        self.run, self.late = 0, []

    def end_run(self) -> None:
        if self.run:
            k = self.run.bit_length() - 1
            self.events.append((k << 4, self.run - (1 << k), k))
            self.run = 0
        self.events += [(None, b, 1) for b in self.late]
        self.late = []

    def first(self, v: list[int], low: int) -> None:
        zeros = 0
        for x in v:
            size = abs(x) >> low
            if not size:
                zeros += 1
                continue
            self.end_run()
            while zeros > 15:
                self.events.append((0xF0, 0, 0))
                zeros -= 16
            k = size.bit_length()
            self.events.append((zeros << 4 | k, size if x > 0 else size ^ ((1 << k) - 1), k))
            zeros = 0
        self._rest(zeros, [])

    def refine(self, v: list[int], low: int) -> None:
        size = [abs(x) >> low for x in v]
        last_new = max((i for i, x in enumerate(size) if x == 1), default=-1)
        zeros, bits = 0, []
        for i, x in enumerate(size):
            if not x:
                zeros += 1
                continue
            while zeros > 15 and i <= last_new:
                self.end_run()
                self.events.append((0xF0, 0, 0))
                self.events += [(None, b, 1) for b in bits]
                zeros, bits = zeros - 16, []
            if x > 1:
                bits.append(x & 1)
                continue
            self.end_run()
            self.events.append((zeros << 4 | 1, int(v[i] > 0), 1))
            self.events += [(None, b, 1) for b in bits]
            zeros, bits = 0, []
        self._rest(zeros, bits)

    def _rest(self, zeros: int, bits: list[int]) -> None:
        if zeros or bits:
            self.run += 1
            self.late += bits
            if self.run == 0x7FFF or len(self.late) > 900:
                self.end_run()


def _progressive_scans(parts: list, sizes: list[tuple[int, int]], mx: int, my: int) -> list[bytes]:
    """DHT and SOS segments with their data: each scan has tables of its own."""
    out = []
    for comps, ss, se, high, low in COLOR_SCANS if len(parts) == 3 else GRAY_SCANS:
        events: list[tuple] = []  # (table, symbol, bits, number of bits)
        if ss == 0:
            last = [0] * len(parts)
            units = [(0, y * parts[0][3] + x) for y in range(sizes[0][1]) for x in range(sizes[0][0])] if len(comps) == 1 else [(i, (n // mx * parts[i][2] + v) * parts[i][3] + n % mx * parts[i][1] + u) for n in range(mx * my) for i in comps for v in range(parts[i][2]) for u in range(parts[i][1])]
            for i, b in units:
                v = parts[i][0][b][0]
                if high:
                    events.append((0, None, v >> low & 1, 1))
                    continue
                d = (v >> low) - last[i]
                last[i] = v >> low
                k = abs(d).bit_length()
                events.append((parts[i][4], k, (d if d > 0 else d - 1) & ((1 << k) - 1), k))
        else:
            i = comps[0]
            band = _Band()
            for y in range(sizes[i][1]):
                for x in range(sizes[i][0]):
                    v = parts[i][0][y * parts[i][3] + x][ss : se + 1]
                    band.refine(v, low) if high else band.first(v, low)
            band.end_run()
            events = [(parts[i][4], *e) for e in band.events]
        counts: dict[int, dict] = {}
        for t, s, _, _ in events:
            if s is not None:
                d = counts.setdefault(t, {})
                d[s] = d.get(s, 0) + 1
        tables = {t: optimal_table(d) for t, d in counts.items()}
        codes = {t: canonical(*x) for t, x in tables.items()}
        w = _Writer()
        for t, s, bits, k in events:
            if s is not None:
                w.put(*codes[t][s])
            if k:
                w.put(bits, k)
        w.flush()
        for t, (n, symbols) in sorted(tables.items()):
            out.append(_segment(0xC4, bytes([(0x10 if ss else 0) | t]) + bytes(n) + bytes(symbols)))
        named = b"".join(bytes([i + 1, parts[i][4] << 4 | parts[i][4]]) for i in comps)
        out.append(_segment(0xDA, bytes([len(comps)]) + named + bytes([ss, se, high << 4 | low])) + bytes(w.out))
    return out


def _segment(m: int, body: bytes) -> bytes:
    return bytes([255, m]) + struct.pack(">H", len(body) + 2) + body


def encode(image: Raster, quality: int = 75, subsampling: str = "4:2:0", optimize: bool = False, restart_rows: int = 0, progressive: bool = False, exif: bytes | None = None) -> bytes:
    image.validate()
    if progressive and image.mode == "Cmyk8":
        raise unsupported("progressive CMYK")
    if image.mode not in ("L1", "L8", "Rgb8", "Cmyk8"):
        raise unsupported(f"JPEG doesn't take {image.mode}")
    if image.width > 65535 or image.height > 65535:
        raise CodecError("Dimensions", "a JPEG has at most 65535 pixels a side")
    if subsampling not in SAMPLING:
        raise CodecError("Parameter", f"subsampling {subsampling!r}")
    a = image.array()
    luma, chroma = quant_table(LUMINANCE, quality), quant_table(CHROMINANCE, quality)
    color = image.mode == "Rgb8"
    fx, fy = SAMPLING[subsampling] if color else (1, 1)
    planes = rgb_to_ycc(a) if color else [255 - a[:, :, i].astype(np.int32) if image.mode == "Cmyk8" else a[:, :, i].astype(np.int32) for i in range(a.shape[2])]
    h, w = image.height, image.width
    mx, my = -(-w // (8 * fx)), -(-h // (8 * fy))
    parts = []
    for i, p in enumerate(planes):
        sx, sy = (fx, fy) if color and i == 0 else (1, 1)
        if color and i and (fx, fy) != (1, 1):
            p = _down(p, fx, fy)
        p = _pad(p, my * sy * 8, mx * sx * 8)
        blocks = p.reshape(my * sy, 8, mx * sx, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        q = (chroma if color and i else luma).reshape(8, 8)
        c, step = forward_dct(blocks.astype(np.float64)), 8 * q
        levels = (np.sign(c) * ((np.abs(c) + step // 2) // step)).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
        parts.append((levels, sx, sy, mx * sx, int(color and i > 0)))
    kinds = (0, 1) if color else (0,)
    names = (1, 2, 3, 4)
    head = [b"\xff\xd8", _segment(0xEE, b"Adobe\0\x64\0\0\0\0\0") if len(parts) == 4 else _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    if exif:
        if len(exif) > 65533:
            raise CodecError("Parameter", "EXIF data are too long for a segment")
        head.append(_segment(0xE1, exif))
    head += [_segment(0xDB, bytes([t]) + bytes(q.reshape(-1)[ZIGZAG].astype(np.uint8))) for t, q in ((0, luma), (1, chroma)) if t in kinds]
    frame = struct.pack(">BHHB", 8, h, w, len(parts)) + b"".join(bytes([names[i], sx << 4 | sy, t]) for i, (_, sx, sy, _, t) in enumerate(parts))
    if progressive:
        sizes = [(-(-(-(-w * sx // fx)) // 8), -(-(-(-h * sy // fy)) // 8)) for _, sx, sy, _, _ in parts]
        return b"".join([*head, _segment(0xC2, frame), *_progressive_scans([(x.tolist(), *rest) for x, *rest in parts], sizes, mx, my), b"\xff\xd9"])
    restart = restart_rows * mx
    blocks, tables_of, segment = _in_order(parts, mx * my, mx, restart)
    block, table, symbol, bits, size = _events(blocks, tables_of)
    if optimize:
        tables = {(c, t): optimal_table(_counted(symbol[table == 2 * c + t]) or {0: 1}) for c in (0, 1) for t in kinds}
    else:
        tables = {(0, 0): DC_LUMA, (1, 0): AC_LUMA, (0, 1): DC_CHROMA, (1, 1): AC_CHROMA}
    codes = np.zeros((4, 256, 2), np.int64)
    for (c, t), x in tables.items():
        for s, code in canonical(*x).items():
            codes[2 * c + t, s] = code
    code = codes[table, symbol]
    values, sizes = np.stack([code[:, 0], bits], 1).ravel(), np.stack([code[:, 1], size], 1).ravel()
    cuts = 2 * np.searchsorted(segment[block], np.arange(segment[-1] + 2))
    out = b"".join((bytes([255, 0xD0 + (i - 1) % 8]) if i else b"") + _packed(values[lo:hi], sizes[lo:hi]) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)))

    head.append(_segment(0xC0, frame))
    head += [_segment(0xC4, bytes([c << 4 | t]) + bytes(tables[(c, t)][0]) + bytes(tables[(c, t)][1])) for t in kinds for c in (0, 1)]
    if restart:
        head.append(_segment(0xDD, struct.pack(">H", restart)))
    head.append(_segment(0xDA, bytes([len(parts)]) + b"".join(bytes([names[i], t << 4 | t]) for i, (*_, t) in enumerate(parts)) + b"\0\x3f\0"))
    return b"".join(head) + out + b"\xff\xd9"
