"""Lossy WebP against frames written here, with tables made by a rule (the decoder works with any)."""

import json
import struct

import numpy as np
import pytest

from rasterloom.functions import codecs
from rasterloom.functions.codecs import vp8, webp
from rasterloom.functions.codecs.base import CodecError


class Encoder:
    """Arithmetic coding with exact integers: the interval is kept as a big number."""

    def __init__(self):
        self.low, self.range, self.bits = 0, 255, 0

    def bit(self, b, p=128):
        split = 1 + ((self.range - 1) * p >> 8)
        if b:
            self.low += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            self.low <<= 1
            self.bits += 1

    def literal(self, v, n):
        for i in range(n - 1, -1, -1):
            self.bit(v >> i & 1)

    def done(self):
        total = self.bits + 8
        return (self.low << -total % 8).to_bytes(-(-total // 8), "big") + b"\0\0"


def tables():
    rng = np.random.default_rng(1)
    return vp8.Tables.of(rng.integers(1, 256, (4, 8, 3, 11)), np.full((4, 8, 3, 11), 200), rng.integers(1, 256, (10, 10, 9)))


def test_bool_decoder_reads_what_was_coded():
    rng = np.random.default_rng(0)
    bits = [(int(rng.random() * 256 >= p), int(p)) for p in rng.integers(1, 256, 5000)]
    e = Encoder()
    for b, p in bits:
        e.bit(b, p)
    d = vp8.BoolDecoder(e.done())
    assert [d.bit(p) for _, p in bits] == [b for b, _ in bits]


def token(e, t, kind, context, n, values):
    """The coefficients of a block in scan order from place n on."""
    band, p = vp8.BANDS, t.coefficients[kind]
    last = max((i for i in range(n, 16) if values[i]), default=-1)
    while True:
        q = p[band[n]][context]
        if n > last:
            e.bit(0, q[0])
            return int(last >= 0)
        e.bit(1, q[0])
        while not values[n]:
            e.bit(0, q[1])
            n += 1
            q = p[band[n]][0]
        e.bit(1, q[1])
        v, context = abs(values[n]), 1
        if v == 1:
            e.bit(0, q[2])
        else:
            e.bit(1, q[2])
            context = 2
            if v < 5:
                e.bit(0, q[3])
                e.bit(v > 2, q[4])
                if v > 2:
                    e.bit(v - 3, q[5])
            elif v < 11:
                e.bit(1, q[3])
                e.bit(0, q[6])
                e.bit(v > 6, q[7])
                if v < 7:
                    e.bit(v - 5, 159)
                else:
                    e.bit(v - 7 >> 1, 165)
                    e.bit(v - 7 & 1, 145)
            else:
                c = max(i for i in range(4) if v >= 3 + (8 << i))
                e.bit(1, q[3])
                e.bit(1, q[6])
                e.bit(c >> 1, q[8])
                e.bit(c & 1, q[9 + (c >> 1)])
                for i, r in enumerate(vp8.LARGE[c]):
                    e.bit(v - 3 - (8 << c) >> (len(vp8.LARGE[c]) - 1 - i) & 1, r)
        e.bit(values[n] < 0)
        n += 1
        if n == 16:
            return 1


def frame(w, h, macroblocks, level=0, quant=10):
    """macroblocks: for each, in order, (luma mode, chroma mode, the 25 blocks Y2, 16 Y, 4 U, 4 V in scan order)."""
    t, head, body = tables(), Encoder(), Encoder()
    head.literal(0, 2)
    head.literal(0, 1)  # no segments
    head.literal(0, 1)
    head.literal(level, 6)
    head.literal(0, 3)
    head.literal(0, 1)
    head.literal(0, 2)
    head.literal(quant, 7)
    for _ in range(5):
        head.literal(0, 1)
    head.literal(0, 1)
    for u in np.ravel(t.updates).tolist():
        head.bit(0, u)
    head.literal(0, 1)  # no skipping
    mw = w + 15 >> 4
    above, left = np.zeros((mw, 9), int), None
    for i, (luma, chroma, blocks) in enumerate(macroblocks):
        head.bit(1, 145)
        head.bit(luma in (vp8.TM, vp8.HORIZONTAL), 156)
        head.bit(luma in (vp8.TM, vp8.VERTICAL), 128 if luma in (vp8.TM, vp8.HORIZONTAL) else 163)
        head.bit(chroma != vp8.DC, 142)
        if chroma != vp8.DC:
            head.bit(chroma != vp8.VERTICAL, 114)
            if chroma != vp8.VERTICAL:
                head.bit(chroma == vp8.TM, 183)
        if i % mw == 0:
            left = np.zeros(9, int)
        a = above[i % mw]
        a[8] = left[8] = token(body, t, 1, a[8] + left[8], 0, blocks[0])
        for base, at, side, kind in ((1, 0, 4, 0), (17, 4, 2, 2), (21, 6, 2, 2)):
            for j in range(side * side):
                r, s = at + j // side, at + j % side
                a[s] = left[r] = token(body, t, kind, a[s] + left[r], int(base == 1), blocks[base + j])
    first = head.done()
    tag = len(first) << 5 | 1 << 4
    return tag.to_bytes(3, "little") + b"\x9d\x01\x2a" + struct.pack("<HH", w, h) + first + body.done()


NONE = [[0] * 16 for _ in range(25)]


def test_flat_frames_and_a_dc_step():
    assert np.unique(vp8.decode(frame(20, 10, [(vp8.DC, vp8.DC, NONE)] * 2), tables())).tolist() == [130]
    blocks = [list(x) for x in NONE]
    blocks[0][0] = 40
    dc = (40 * 2 * vp8.DC_STEPS[10] + 3 >> 3) + 4 >> 3
    y = vp8._Frame(frame(16, 16, [(vp8.DC, vp8.DC, blocks)]), tables()).planes()[0]
    assert np.unique(y).tolist() == [128 + dc]


def test_modes_residuals_and_filter_by_plain_formulas():
    rng = np.random.default_rng(4)
    mbs = []
    for i in range(6):
        blocks = [[int(v) for v in rng.integers(-3, 4, 16) * (rng.random(16) < 0.2)] for _ in range(25)]
        blocks[0][0], blocks[3][5], blocks[5][1] = int(rng.integers(-60, 60)), 2100 if i == 2 else 9, -17
        mbs.append(((vp8.DC, vp8.VERTICAL, vp8.HORIZONTAL, vp8.TM)[i % 4], (vp8.TM, vp8.DC, vp8.HORIZONTAL, vp8.VERTICAL)[i % 4], blocks))
    data = frame(48, 32, mbs)
    y = vp8._Frame(data, tables()).planes()[0].astype(int)
    canvas = np.full((33, 49), 127)
    canvas[1:, 0] = 129
    for i, (mode, _, blocks) in enumerate(mbs):
        r, c = 16 * (i // 3), 16 * (i % 3)
        above, left, corner = canvas[r, c + 1 : c + 17].copy(), canvas[r + 1 : r + 17, c].copy(), canvas[r, c]
        if mode == vp8.DC:
            have = [v for v, there in ((above, r), (left, c)) if there]
            guess = np.full((16, 16), int(np.floor(np.concatenate(have).mean() + 0.5)) if have else 128)
        else:
            guess = {vp8.VERTICAL: np.tile(above, (16, 1)), vp8.HORIZONTAL: np.tile(left[:, None], (1, 16)), vp8.TM: np.clip(left[:, None] + above[None] - corner, 0, 255)}[mode]
        natural = np.zeros((25, 16), int)
        for k, x in enumerate(blocks):
            natural[k, list(vp8.ZIGZAG)] = x
        y2 = natural[0] * np.r_[2 * vp8.DC_STEPS[10], [max(vp8.AC_STEPS[10] * 155 // 100, 8)] * 15]
        wht = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
        dcs = (wht.T @ y2.reshape(4, 4) @ wht + 3 >> 3).ravel()
        for k in range(16):
            co = natural[1 + k] * vp8.AC_STEPS[10]
            co[0] = dcs[k]
            res = vp8.inverse_dct(co.reshape(1, 4, 4))[0]
            br, bc = 4 * (k // 4), 4 * (k % 4)
            canvas[r + 1 + br : r + 5 + br, c + 1 + bc : c + 5 + bc] = np.clip(guess[br : br + 4, bc : bc + 4] + res, 0, 255)
    assert np.array_equal(y, canvas[1:, 1:])
    filtered = vp8._Frame(frame(48, 32, mbs, level=30), tables()).planes()[0].astype(int)
    assert (filtered != y).any() and np.abs(np.diff(filtered, axis=1)).sum() < np.abs(np.diff(y, axis=1)).sum()


def test_inverse_transforms_are_close_to_real_ones():
    c = np.random.default_rng(2).integers(-400, 400, (50, 4, 4))
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 8) * (0.5**0.5 if u == 0 else 1) for u in range(4)] for x in range(4)])
    assert np.abs(vp8.inverse_dct(c) - np.einsum("yu,nuv,xv->nyx", basis, c, basis) / 4).max() <= 1.5


def test_block_predictions():
    above, left = [10, 20, 30, 40, 50, 60, 70, 80], [12, 22, 32, 42]
    flat = vp8.block_prediction
    for mode in range(10):
        assert flat(mode, [9] * 8, [9] * 4, 9) == [[9] * 4] * 4
    assert flat(vp8.LEFT_DOWN, above, left, 5)[0] == [20, 30, 40, 50] and flat(vp8.LEFT_DOWN, above, left, 5)[3][3] == 78
    assert flat(vp8.VERTICAL_LEFT, above, left, 5) == [[15, 25, 35, 45], [20, 30, 40, 50], [25, 35, 45, 60], [30, 40, 50, 70]]
    assert flat(vp8.HORIZONTAL_UP, above, left, 5)[3] == [42] * 4 and flat(vp8.HORIZONTAL_UP, above, left, 5)[0] == [17, 22, 27, 32]
    down = flat(vp8.RIGHT_DOWN, above, left, 5)
    assert [down[i][i] for i in range(4)] == [8] * 4 and down[3][0] == 32 and down[0][3] == 30


@pytest.mark.parametrize("method", range(4))
def test_alpha_chunk(method, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (10, 20))
    guess = np.zeros((10, 20), int)
    for y in range(10):
        for x in range(20):
            up, side, corner = (int(a[y - 1, x]) if y else None), (int(a[y, x - 1]) if x else None), (int(a[y - 1, x - 1]) if x and y else None)
            inner = {0: 0, 1: side, 2: up, 3: None if corner is None else min(max(up + side - corner, 0), 255)}[method]
            guess[y, x] = 0 if not method or not (x or y) else inner if x and y else side if x else up
    chunk = bytes([method << 2]) + (a - guess & 255).astype(np.uint8).tobytes()
    head = bytes([16, 0, 0, 0]) + (19).to_bytes(3, "little") + (9).to_bytes(3, "little")
    blob = webp.riff([(b"VP8X", head), (b"ALPH", chunk), (b"VP8 ", frame(20, 10, [(vp8.DC, vp8.DC, NONE)] * 2))])
    monkeypatch.delenv(webp.TABLES, raising=False)
    with pytest.raises(CodecError, match="tables"):
        codecs.decode(blob)
    t = tables()
    path = tmp_path / "tables.json"
    path.write_text(json.dumps({"coefficients": t.coefficients, "updates": t.updates, "block_modes": t.block_modes}))
    monkeypatch.setenv(webp.TABLES, str(path))
    got = codecs.decode(blob)[1].value
    assert got.mode == "Rgba8" and np.array_equal(got.array()[:, :, 3], a) and np.unique(got.array()[:, :, :3]).tolist() == [130]
