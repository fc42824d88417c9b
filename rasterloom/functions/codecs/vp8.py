"""Key frames of VP8, the lossy bitstream of WebP: arithmetic decoding, prediction, transforms, loop filter, colour.

The format has three tables of probabilities with over a thousand entries, which no rule gives: `Tables` takes
them as a parameter (WEBP_TABLES names a file of them). Without it lossy pixels are refused."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from rasterloom.functions.codecs.base import CodecError, check_pixels, malformed, unsupported

# Quantiser steps, scan order, bands, and probabilities of modes and of large coefficients.
# fmt: off
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEPS = (
    *range(4, 58), 58, *range(60, 117, 2), *range(119, 174, 3), *range(177, 230, 4), 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
LARGE = ((173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
# fmt: on
DC, TM, VERTICAL, HORIZONTAL, LEFT_DOWN, RIGHT_DOWN, VERTICAL_RIGHT, VERTICAL_LEFT, HORIZONTAL_DOWN, HORIZONTAL_UP = range(10)
WHOLE_BLOCKS = -1  # a macroblock whose 16 blocks have modes of their own


@dataclass(frozen=True)
class Tables:
    """coefficients and updates: [4][8][3][11] probabilities; block_modes: [10][10][9], by the modes above and to the left."""

    coefficients: tuple
    updates: tuple
    block_modes: tuple

    @staticmethod
    def of(coefficients, updates, block_modes) -> Tables:
        shaped = [np.asarray(x, np.int64) for x in (coefficients, updates, block_modes)]
        if [x.shape for x in shaped] != [(4, 8, 3, 11), (4, 8, 3, 11), (10, 10, 9)]:
            raise CodecError("Parameter", "tables of another shape")
        return Tables(*(x.tolist() for x in shaped))


@lru_cache(maxsize=2)
def load_tables(path: str) -> Tables:
    """From a JSON file with the lists `coefficients`, `updates` and `block_modes`."""
    with open(path) as f:
        x = json.load(f)
    return Tables.of(x["coefficients"], x["updates"], x["block_modes"])


class BoolDecoder:
    """Arithmetic decoding of bits with probabilities of zero in 256ths; zeros follow the data's end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.spare, self.range = data, 0, 0, -8, 255

    def bit(self, p: int) -> int:
        if self.spare < 0:
            word = self.data[self.at : self.at + 4]
            self.value = self.value << 32 | int.from_bytes(word, "big") << 8 * (4 - len(word))
            self.at += 4
            self.spare += 32
        split = 1 + ((self.range - 1) * p >> 8)
        bound = split << self.spare
        if self.value >= bound:
            self.value -= bound
            r, out = self.range - split, 1
        else:
            r, out = split, 0
        shift = 8 - r.bit_length()
        self.range = r << shift
        self.spare -= shift
        return out

    def literal(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit(128)
        return v

    def optional(self, n: int) -> int:
        """A flag and, where it is set, n bits and a sign."""
        if not self.bit(128):
            return 0
        v = self.literal(n)
        return -v if self.bit(128) else v


def inverse_dct(c: np.ndarray) -> np.ndarray:
    """(n, 4, 4) coefficients to residuals, columns first."""

    def four(a, b, c, d):
        sine, cosine = (lambda v: v * 35468 >> 16), (lambda v: v + (v * 20091 >> 16))
        inner, outer = sine(b) - cosine(d), cosine(b) + sine(d)
        return a + c + outer, a - c + inner, a - c - inner, a + c - outer

    v = np.stack(four(*(c[:, k] for k in range(4))), axis=1)
    return np.stack(four(*(v[:, :, k] for k in range(4))), axis=2) + 4 >> 3


def inverse_wht(c: np.ndarray) -> np.ndarray:
    def four(a, b, c, d):
        return a + d + b + c, b - c + a - d, a + d - b - c, a - d - b + c

    v = np.stack(four(*c), axis=0)
    return np.stack(four(*v.T), axis=1) + 3 >> 3


def block_prediction(mode: int, above: list[int], left: list[int], corner: int) -> list[list[int]]:
    """4 x 4 samples from 8 above, 4 to the left and the corner."""
    a, e = above, [*left[::-1], corner, *above]
    two = lambda v, i: v[i] + v[i + 1] + 1 >> 1
    three = lambda v, i: v[i] + 2 * v[i + 1] + v[i + 2] + 2 >> 2
    low, at = [*left, left[3]], range(4)
    if mode == DC:
        return [[sum(a[:4]) + sum(left) + 4 >> 3] * 4] * 4
    if mode == TM:
        return [[min(max(y + x - corner, 0), 255) for x in a[:4]] for y in left]
    if mode == VERTICAL:
        return [[three(e, 4 + x) for x in at]] * 4
    if mode == HORIZONTAL:
        side = [corner, *low]
        return [[three(side, y)] * 4 for y in at]
    if mode == LEFT_DOWN:
        more = [*a, a[7]]
        return [[three(more, x + y) for x in at] for y in at]
    if mode == RIGHT_DOWN:
        return [[three(e, 3 - y + x) for x in at] for y in at]
    if mode == VERTICAL_RIGHT:
        def cell(y: int, x: int) -> int:
            d = 2 * x - y
            return three(e, 4 + d) if d < -1 else three(e, 3 + (d + 1) // 2) if d % 2 else two(e, 4 + d // 2)
    elif mode == HORIZONTAL_DOWN:
        def cell(y: int, x: int) -> int:
            d = 2 * y - x
            return three(e, 2 - d) if d < -1 else three(e, 3 - (d + 1) // 2) if d % 2 else two(e, 3 - d // 2)
    elif mode == VERTICAL_LEFT:
        def cell(y: int, x: int) -> int:
            if x == 3 and y >= 2:
                return three(a, 2 + y)
            return three(a, x + y // 2) if y % 2 else two(a, x + y // 2)
    else:
        def cell(y: int, x: int) -> int:
            d = x + 2 * y
            return left[3] if d > 5 else three(low, d // 2) if d % 2 else two(low, d // 2)
    return [[cell(y, x) for x in at] for y in at]


class _Frame:
    def __init__(self, data: bytes, tables: Tables):
        if len(data) < 10 or data[0] & 1 or data[3:6] != b"\x9d\x01\x2a":
            raise malformed("no key frame", None, "webp_bitstream")
        tag = int.from_bytes(data[:3], "little")
        if tag >> 1 & 7 > 3:
            raise unsupported("unknown VP8 version", None, "webp_bitstream")
        first = tag >> 5
        self.w, self.h = int.from_bytes(data[6:8], "little") & 0x3FFF, int.from_bytes(data[8:10], "little") & 0x3FFF
        check_pixels(self.w, self.h)
        if 10 + first > len(data):
            raise malformed("the first partition ends early", None, "webp_bitstream")
        self.tables, self.mw, self.mh = tables, self.w + 15 >> 4, self.h + 15 >> 4
        self.b = b = BoolDecoder(data[10 : 10 + first])
        b.literal(2)  # colour space and clamping
        self._segments(b)
        self.simple, self.level, self.sharpness = b.literal(1), b.literal(6), b.literal(3)
        self.deltas = [0] * 8
        self.adjust = b.literal(1)
        if self.adjust and b.literal(1):
            self.deltas = [b.optional(6) for _ in range(8)]
        self._partitions(data, 10 + first, 1 << b.literal(2))
        self._quantisers(b)
        b.literal(1)  # whether probabilities are kept for later frames
        self.probabilities = [[[[b.literal(8) if b.bit(u) else p for p, u in zip(ps, us, strict=True)] for ps, us in zip(pc, uc, strict=True)] for pc, uc in zip(pb, ub, strict=True)] for pb, ub in zip(tables.coefficients, tables.updates, strict=True)]
        self.skipping = b.literal(1)
        self.skip_probability = b.literal(8) if self.skipping else 0

    def _segments(self, b: BoolDecoder) -> None:
        self.segmented, self.mapped = b.literal(1), 0
        self.absolute, self.segment_quant, self.segment_level, self.tree = 0, [0] * 4, [0] * 4, [255] * 3
        if self.segmented:
            self.mapped, update = b.literal(1), b.literal(1)
            if update:
                self.absolute = b.literal(1)
                self.segment_quant = [b.optional(7) for _ in range(4)]
                self.segment_level = [b.optional(6) for _ in range(4)]
            if self.mapped:
                self.tree = [b.literal(8) if b.bit(128) else 255 for _ in range(3)]

    def _partitions(self, data: bytes, at: int, n: int) -> None:
        sizes, begin = [int.from_bytes(data[at + 3 * i : at + 3 * i + 3], "little") for i in range(n - 1)], at + 3 * (n - 1)
        self.parts = []
        for i in range(n):
            end = begin + sizes[i] if i < n - 1 else len(data)
            if end > len(data) or begin > len(data):
                raise malformed("a partition ends early", None, "webp_bitstream")
            self.parts.append(BoolDecoder(data[begin:end]))
            begin = end

    def _quantisers(self, b: BoolDecoder) -> None:
        base = b.literal(7)
        y_dc, y2_dc, y2_ac, uv_dc, uv_ac = (b.optional(4) for _ in range(5))
        step = lambda t, i: t[min(max(i, 0), 127)]
        self.quant = []
        for s in range(4):
            q = base if not self.segmented else self.segment_quant[s] + (0 if self.absolute else base)
            q = min(max(q, 0), 127)
            y = (step(DC_STEPS, q + y_dc), step(AC_STEPS, q))
            y2 = (2 * step(DC_STEPS, q + y2_dc), max(step(AC_STEPS, q + y2_ac) * 155 // 100, 8))
            uv = (min(step(DC_STEPS, q + uv_dc), 132), step(AC_STEPS, q + uv_ac))
            self.quant.append((y, y2, uv))

    def _macroblock_modes(self, x: int, above: list, left: list) -> tuple:
        """(segment, skipped, luma mode, modes of the blocks, chroma mode)"""
        b = self.b
        segment = 0
        if self.mapped:
            segment = 2 + b.bit(self.tree[2]) if b.bit(self.tree[0]) else b.bit(self.tree[1])
        skipped = b.bit(self.skip_probability) if self.skipping else 0
        if not b.bit(145):
            luma, modes = WHOLE_BLOCKS, []
            for _ in range(4):
                for i in range(4):
                    p = self.tables.block_modes[above[4 * x + i]][left[len(modes) // 4]]
                    mode = self._block_mode(p)
                    above[4 * x + i] = left[len(modes) // 4] = mode
                    modes.append(mode)
        else:
            luma = (TM if b.bit(128) else HORIZONTAL) if b.bit(156) else (VERTICAL if b.bit(163) else DC)
            modes = [luma] * 16
            above[4 * x : 4 * x + 4] = left[:] = [luma] * 4
        chroma = DC if not b.bit(142) else VERTICAL if not b.bit(114) else TM if b.bit(183) else HORIZONTAL
        return segment, skipped, luma, modes, chroma

    def _block_mode(self, p: list[int]) -> int:
        bit = self.b.bit
        if not bit(p[0]):
            return DC
        if not bit(p[1]):
            return TM
        if not bit(p[2]):
            return VERTICAL
        if not bit(p[3]):
            if not bit(p[4]):
                return HORIZONTAL
            return VERTICAL_RIGHT if bit(p[5]) else RIGHT_DOWN
        if not bit(p[6]):
            return LEFT_DOWN
        if not bit(p[7]):
            return VERTICAL_LEFT
        return HORIZONTAL_UP if bit(p[8]) else HORIZONTAL_DOWN

    def _coefficients(self, b: BoolDecoder, kind: int, context: int, n: int, steps: tuple[int, int], out: np.ndarray) -> int:
        """Read a block's coefficients into out; whether there are any."""
        probabilities, bit = self.probabilities[kind], b.bit
        p = probabilities[BANDS[n]][context]
        if not bit(p[0]):
            return 0
        while True:
            while not bit(p[1]):
                n += 1
                if n == 16:
                    return 1
                p = probabilities[BANDS[n]][0]
            if not bit(p[2]):
                v, context = 1, 1
            else:
                context = 2
                if not bit(p[3]):
                    v = 2 if not bit(p[4]) else 3 + bit(p[5])
                elif not bit(p[6]):
                    v = 5 + bit(159) if not bit(p[7]) else 7 + 2 * bit(165) + bit(145)
                else:
                    c = bit(p[8])
                    c = 2 * c + bit(p[9 + c])
                    v = 0
                    for q in LARGE[c]:
                        v = 2 * v + bit(q)
                    v += 3 + (8 << c)
            out[ZIGZAG[n]] = (-v if bit(128) else v) * steps[n > 0]
            n += 1
            if n == 16:
                return 1
            p = probabilities[BANDS[n]][context]
            if not bit(p[0]):
                return 1

    def _residuals(self, b: BoolDecoder, mb: tuple, above: np.ndarray, left: np.ndarray) -> tuple[np.ndarray | None, bool]:
        """(24, 4, 4) residuals (16 luma, 4 + 4 chroma), None if there are none; above and left: flags of 4 + 2 + 2 + 1 blocks."""
        segment, skipped, luma, _, _ = mb
        if skipped:
            keep = (above[8], left[8])
            above[:], left[:] = 0, 0
            if luma == WHOLE_BLOCKS:
                above[8], left[8] = keep
            return None, False
        y, y2, uv = self.quant[segment]
        c = np.zeros((24, 16), np.int64)
        first, kind, some = 0, 3, 0
        if luma != WHOLE_BLOCKS:
            dc = np.zeros(16, np.int64)
            above[8] = left[8] = self._coefficients(b, 1, int(above[8] + left[8]), 0, y2, dc)
            c[:16, 0] = inverse_wht(dc.reshape(4, 4)).ravel()
            some |= int(c[:16, 0].any())
            first, kind = 1, 0
        for base, at, side, k, steps in ((0, 0, 4, kind, y), (16, 4, 2, 2, uv), (20, 6, 2, 2, uv)):
            for i in range(side * side):
                r, s = at + i // side, at + i % side
                above[s] = left[r] = found = self._coefficients(b, k, int(above[s] + left[r]), first if not base else 0, steps, c[base + i])
                some |= found
        return inverse_dct(c.reshape(24, 4, 4)), bool(some)

    def _predicted(self, plane: np.ndarray, y: int, x: int, n: int, mode: int) -> np.ndarray:
        """n x n samples at (y, x) of a plane that has a border of one sample above and to the left."""
        above, left = plane[y, x + 1 : x + n + 1].astype(np.int64), plane[y + 1 : y + n + 1, x].astype(np.int64)
        if mode == VERTICAL:
            return np.broadcast_to(above, (n, n))
        if mode == HORIZONTAL:
            return np.broadcast_to(left[:, None], (n, n))
        if mode == TM:
            return np.clip(left[:, None] + above - int(plane[y, x]), 0, 255)
        sides = [v for v, there in ((above, y), (left, x)) if there]
        level = (int(sum(v.sum() for v in sides)) + n * len(sides) // 2) // (n * len(sides)) if sides else 128
        return np.full((n, n), level)

    def planes(self) -> list[np.ndarray]:
        """Luma and chroma planes of whole macroblocks, filtered."""
        shapes = [(16 * self.mh, 16 * self.mw), (8 * self.mh, 8 * self.mw), (8 * self.mh, 8 * self.mw)]
        planes = [np.full((h + 1, w + 1 + 4), 127, np.uint8) for h, w in shapes]
        for p in planes:
            p[1:, 0] = 129
        modes_above, flags_above = [DC] * (4 * self.mw), np.zeros((self.mw, 9), np.int64)
        filters = []
        for my in range(self.mh):
            part = self.parts[my % len(self.parts)]
            modes_left, flags_left = [DC] * 4, np.zeros(9, np.int64)
            for mx in range(self.mw):
                mb = self._macroblock_modes(mx, modes_above, modes_left)
                residual, some = self._residuals(part, mb, flags_above[mx], flags_left)
                self._reconstruct(planes, my, mx, mb, residual)
                filters.append((mb[0], mb[2] == WHOLE_BLOCKS, some or mb[2] == WHOLE_BLOCKS))
        out = [p[1:, 1 : 1 + w].astype(np.int16) for p, (_, w) in zip(planes, shapes, strict=True)]
        if self.level:
            self._filter(out, filters)
        return [p.astype(np.uint8) for p in out]

    def _reconstruct(self, planes: list, my: int, mx: int, mb: tuple, residual: np.ndarray | None) -> None:
        _, _, luma, modes, chroma = mb
        y, x, plane = 16 * my, 16 * mx, planes[0]
        if luma == WHOLE_BLOCKS:
            # The four samples above and to the right of the macroblock serve all of its rows.
            beyond = plane[y, x + 17 : x + 21].tolist() if not my or mx < self.mw - 1 else [int(plane[y, x + 16])] * 4
            for i, mode in enumerate(modes):
                r, c = y + 4 * (i // 4), x + 4 * (i % 4)
                above = plane[r, c + 1 : c + 5].tolist() + (beyond if i % 4 == 3 else plane[r, c + 5 : c + 9].tolist())
                block = np.array(block_prediction(mode, above, plane[r + 1 : r + 5, c].tolist(), int(plane[r, c])))
                plane[r + 1 : r + 5, c + 1 : c + 5] = block if residual is None else np.clip(block + residual[i], 0, 255)
        else:
            self._add(plane, y, x, 16, self._predicted(plane, y, x, 16, luma), None if residual is None else residual[:16])
        for k, p in enumerate(planes[1:]):
            own = None if residual is None else residual[16 + 4 * k : 20 + 4 * k]
            self._add(p, y // 2, x // 2, 8, self._predicted(p, y // 2, x // 2, 8, chroma), own)

    @staticmethod
    def _add(plane: np.ndarray, y: int, x: int, n: int, block: np.ndarray, residual: np.ndarray | None) -> None:
        if residual is not None:
            k = n // 4
            block = np.clip(block + residual.reshape(k, k, 4, 4).transpose(0, 2, 1, 3).reshape(n, n), 0, 255)
        plane[y + 1 : y + n + 1, x + 1 : x + n + 1] = block

    def _filter(self, planes: list, filters: list) -> None:
        for at, (segment, blocks, inner) in enumerate(filters):
            my, mx = divmod(at, self.mw)
            level = self.level if not self.segmented else self.segment_level[segment] + (0 if self.absolute else self.level)
            if self.adjust:
                level += self.deltas[0] + (self.deltas[4] if blocks else 0)
            level = min(max(level, 0), 63)
            if not level:
                continue
            inside = level
            if self.sharpness:
                inside = min(inside >> (2 if self.sharpness > 4 else 1), 9 - self.sharpness)
            inside = max(inside, 1)
            high = 2 if level >= 40 else 1 if level >= 15 else 0
            for p, n in zip(planes[: 1 if self.simple else 3], (16, 8, 8), strict=False):
                box = p[n * my : n * my + n]
                for across in (True, False):  # edges between columns, then between rows
                    lines = box if across else p[:, n * mx : n * mx + n].T
                    begin = n * (mx if across else my)
                    if mx if across else my:
                        edge(lines, begin, 2 * (level + 2) + inside, inside, high, True, self.simple)
                    if inner:
                        for e in range(4, n, 4):
                            edge(lines, begin + e, 2 * level + inside, inside, high, False, self.simple)


def _c(v: np.ndarray) -> np.ndarray:
    return np.clip(v, -128, 127)


def edge(lines: np.ndarray, at: int, limit: int, inside: int, high: int, outer: bool, simple: int) -> None:
    """Filter rows of samples across the edge before column `at`, in place."""
    s = lines[:, at - 4 : at + 4].astype(np.int32) - 128
    p3, p2, p1, p0, q0, q1, q2, q3 = s.T
    go = np.abs(p0 - q0) * 2 + (np.abs(p1 - q1) >> 1) <= limit
    if not simple:
        steps = np.abs(np.diff(s, axis=1))
        go &= (steps[:, [0, 1, 2, 4, 5, 6]] <= inside).all(axis=1)
    if not go.any():
        return
    out = s.copy()
    if simple:
        a = _c(_c(p1 - q1) + 3 * (q0 - p0))
        out[:, 3], out[:, 4] = _c(p0 + (_c(a + 3) >> 3)), _c(q0 - (_c(a + 4) >> 3))
    else:
        uneven = (np.abs(p1 - p0) > high) | (np.abs(q1 - q0) > high)
        a = _c(np.where(uneven | outer, _c(p1 - q1), 0) + 3 * (q0 - p0))
        up, down = _c(a + 3) >> 3, _c(a + 4) >> 3
        if outer:
            out[:, 3], out[:, 4] = np.where(uneven, _c(p0 + up), p0), np.where(uneven, _c(q0 - down), q0)
            for weight, i, j in ((27, 3, 4), (18, 2, 5), (9, 1, 6)):
                move = _c(weight * a + 63 >> 7)
                out[:, i], out[:, j] = np.where(uneven, out[:, i], _c(s[:, i] + move)), np.where(uneven, out[:, j], _c(s[:, j] - move))
        else:
            out[:, 3], out[:, 4] = _c(p0 + up), _c(q0 - down)
            half = down + 1 >> 1
            out[:, 2], out[:, 5] = np.where(uneven, p1, _c(p1 + half)), np.where(uneven, q1, _c(q1 - half))
    lines[:, at - 4 : at + 4] = np.where(go[:, None], out, s) + 128


def upsample(p: np.ndarray, h: int, w: int) -> np.ndarray:
    """Chroma at full size: 9, 3, 3 and 1 sixteenths of the four nearest samples."""
    v = p.astype(np.int32)

    def sides(n: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(n)
        return i // 2, np.clip(i // 2 + np.where(i % 2, 1, -1), 0, limit - 1)

    (y, far_y), (x, far_x) = sides(h, (h + 1) // 2), sides(w, (w + 1) // 2)
    rows = 3 * v[y] + v[far_y]
    return 3 * rows[:, x] + rows[:, far_x] + 8 >> 4


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    part = lambda x, k: x.astype(np.int32) * k >> 8
    luma = part(y, 19077)
    rgb = luma + part(v, 26149) - 14234, luma - part(u, 6419) - part(v, 13320) + 8708, luma + part(u, 33050) - 17685
    return np.clip(np.stack(rgb, axis=-1) >> 6, 0, 255).astype(np.uint8)


def decode(data: bytes, tables: Tables) -> np.ndarray:
    """(height, width, 3) bytes of a key frame."""
    f = _Frame(data, tables)
    y, u, v = f.planes()
    return to_rgb(y[: f.h, : f.w], upsample(u, f.h, f.w), upsample(v, f.h, f.w))
