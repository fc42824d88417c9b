"""PNG and APNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from rasterloom.functions.codecs.base import CodecError, Frame, Info, NeedMore, Raster, Result, Sequence, check_pixels, malformed, pack_bits, unpack, unsupported

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
# Chunks that the decoder reads itself, and those kept as metadata or colour facts.
INTERPRETED = (b"IHDR", b"PLTE", b"tRNS", b"IDAT", b"IEND", b"acTL", b"fcTL", b"fdAT")
METADATA = (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME", b"pHYs")
COLOR = (b"cHRM", b"gAMA", b"iCCP", b"sRGB", b"cICP", b"cLLI", b"mDCV")


def chunks(data: bytes, strict: bool) -> Iterator[tuple[bytes, bytes, int, bool]]:
    """(kind, payload, offset, whether the CRC holds). Before image data a wrong CRC is an error, always so if strict."""
    if len(data) < 8:
        raise NeedMore(8, 0, "png_chunk") if SIGNATURE.startswith(data) else malformed("no PNG signature", 0, "png_chunk")
    if data[:8] != SIGNATURE:
        raise malformed("no PNG signature", 0, "png_chunk")
    at, pixels = 8, False
    while at < len(data):
        if at + 12 > len(data):
            raise NeedMore(at + 12, at, "png_chunk")
        n, kind = struct.unpack_from(">I4s", data, at)
        if n > 0x7FFFFFFF:
            raise malformed("a chunk is too long", at, "png_chunk")
        if at + 12 + n > len(data):
            raise NeedMore(at + 12 + n, at, "png_chunk")
        payload = data[at + 8 : at + 8 + n]
        good = zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack_from(">I", data, at + 8 + n)[0]
        pixels |= kind == b"IDAT"
        if not good and (strict or not pixels):
            raise malformed(f"wrong CRC in {kind.decode('latin1')}", at, "png_chunk")
        yield kind, payload, at, good
        at += 12 + n
        if kind == b"IEND":
            return


def header(payload: bytes) -> tuple[int, int, int, int, int]:
    if len(payload) != 13:
        raise malformed("IHDR has 13 bytes", 8, "png_chunk")
    w, h, depth, color, method, filtering, interlace = struct.unpack(">IIBBBBB", payload)
    if color not in CHANNELS or depth not in DEPTHS[color]:
        raise unsupported(f"colour type {color} with {depth} bits", 8, "png_chunk")
    if method or filtering or interlace > 1:
        raise unsupported("unknown compression, filter or interlace method", 8, "png_chunk")
    check_pixels(w, h)
    return w, h, depth, color, interlace


def mode_of(color: int, depth: int) -> str:
    if color == 0:
        return {1: "L1", 16: "L16"}.get(depth, "L8")
    return {2: "Rgb8", 3: "P8", 4: "Rgba8" if depth == 16 else "La8", 6: "Rgba8"}[color]


def inspect(data: bytes) -> Info:
    head, frames, order = None, 1, False
    for kind, payload, at, _ in chunks(data, False):
        if head is None:
            if kind != b"IHDR":
                raise malformed("IHDR comes first", at, "png_chunk")
            head = header(payload)
        elif kind == b"acTL" and len(payload) >= 8:
            frames, order = struct.unpack_from(">I", payload)[0], True
        elif kind == b"IDAT":
            break
    if head is None:
        raise malformed("no IHDR", 8, "png_chunk")
    return Info(head[0], head[1], mode_of(head[3], head[2]), head[2], frames or 1, order and frames > 1)


def unfilter(raw: bytes, rows: int, stride: int, bpp: int) -> np.ndarray:
    """Rows without their filters; each depends on the one above, and most on what is left of it too."""
    data = np.frombuffer(raw, np.uint8).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, above = int(data[y, 0]), data[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            lanes = np.zeros(-(-stride // bpp) * bpp, np.uint8)
            lanes[:stride] = line
            out[y + 1] = np.cumsum(lanes.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 3:
            own, up, src = bytearray(stride + bpp), above.tolist(), line.tolist()
            for x in range(stride):
                own[x + bpp] = (src[x] + (own[x] + up[x] >> 1)) & 255
            out[y + 1] = np.frombuffer(bytes(own[bpp:]), np.uint8)
        elif kind == 4:
            own, up, src = bytearray(stride + bpp), bytes(bpp) + above.tobytes(), line.tolist()
            for x in range(stride):
                a, b, c = own[x], up[x + bpp], up[x]
                p, q = b - c, a - c
                pa, pb, pc = abs(p), abs(q), abs(p + q)
                own[x + bpp] = (src[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            out[y + 1] = np.frombuffer(bytes(own[bpp:]), np.uint8)
        else:
            raise malformed(f"filter {kind}")
    return out[1:]


def _grids(w: int, h: int, interlace: int) -> list[tuple[int, int, int, int, int, int]]:
    if not interlace:
        return [(0, 0, 1, 1, w, h)]
    sizes = ((x0, y0, dx, dy, -(-(w - x0) // dx), -(-(h - y0) // dy)) for x0, y0, dx, dy in PASSES)
    return [g for g in sizes if g[4] > 0 and g[5] > 0]


def pixels_of(compressed: bytes, w: int, h: int, depth: int, color: int, interlace: int) -> tuple[np.ndarray, bool]:
    """(h, w, channels) samples, and whether the stream goes on past them."""
    n, bits = CHANNELS[color], CHANNELS[color] * depth
    total = sum((1 + -(-gw * bits // 8)) * gh for *_, gw, gh in _grids(w, h, interlace))
    z = zlib.decompressobj()
    try:
        raw = z.decompress(compressed, total)
        more = len(raw) == total and bool(z.decompress(z.unconsumed_tail, 1))
    except zlib.error as e:
        raise malformed(f"image data: {e}") from e
    if len(raw) < total:
        raise malformed("image data end early")
    out = np.zeros((h, w, n), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x0, y0, dx, dy, gw, gh in _grids(w, h, interlace):
        stride = -(-gw * bits // 8)
        rows = unfilter(raw[at : at + (stride + 1) * gh], gh, stride, max(1, bits // 8))
        at += (stride + 1) * gh
        if depth == 16:
            part = rows.reshape(gh, gw, n, 2).astype(np.uint16)
            part = part[..., 0] << 8 | part[..., 1]
        else:
            part = unpack(rows, gw * n, depth).reshape(gh, gw, n)
        out[y0::dy, x0::dx] = part
    return out, more


def build(samples: np.ndarray, depth: int, color: int, palette: bytes | None, alpha: bytes) -> Raster:
    h, w, _ = samples.shape
    mode = mode_of(color, depth)
    if mode == "L1":
        pixels = pack_bits(samples[:, :, 0])
    elif color == 0 and depth < 8:
        pixels = (samples.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8).tobytes()
    elif color == 4 and depth == 16:
        high = (samples >> 8).astype(np.uint8)
        pixels = np.concatenate([high[:, :, :1]] * 3 + [high[:, :, 1:]], axis=2).tobytes()
    elif depth == 16 and color != 0:
        pixels = (samples >> 8).astype(np.uint8).tobytes()
    else:
        pixels = samples.astype("<u2" if depth == 16 else np.uint8).tobytes()
    straight = color in (4, 6) or (color == 3 and bool(alpha))
    own = palette[: len(palette) // 3 * 3] if color == 3 and palette else None
    return Raster(w, h, mode, pixels, own or None, alpha[: len(own) // 3] if own else b"", alpha="Straight" if straight else None)


#: Compressed metadata are inflated up to here to see whether they can be.
MAX_METADATA_OUTPUT = 1 << 20


def _inflates(data: bytes) -> bool:
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, MAX_METADATA_OUTPUT)
    except zlib.error:
        return False
    return stream.eof or len(out) >= MAX_METADATA_OUTPUT


def lost_metadata(kind: bytes, payload: bytes, at: int) -> bool:
    """Whether a well-shaped field of compressed metadata can't be inflated. An unknown method of zTXt or iCCP is an error."""
    keyword, nul, rest = payload.partition(b"\0")
    if kind not in (b"zTXt", b"iCCP", b"iTXt") or not nul or not keyword or len(rest) < 1 + (kind == b"iTXt"):
        return False
    if kind != b"iTXt":
        if rest[0]:
            raise malformed(f"PNG png_{kind.decode()} compression method is unsupported", at, "png_chunk")
        return not _inflates(rest[1:])
    parts = rest[2:].split(b"\0", 2)
    return rest[0] == 1 and len(parts) == 3 and (rest[1] != 0 or not _inflates(parts[2]))


def keep_color(kind: bytes, payload: bytes, color: dict) -> bool:
    """Take the first well-formed chunk of each kind into `color`; others are left as raw metadata."""
    if kind == b"sRGB" and len(payload) == 1 and payload[0] <= 3:
        key, value = "srgb_intent", payload[0]
    elif kind == b"gAMA" and len(payload) == 4:
        key, value = "gamma", struct.unpack(">I", payload)[0]
    elif kind == b"cHRM" and len(payload) == 32:
        key, value = "chromaticities", list(struct.unpack(">8I", payload))
    elif kind == b"iCCP" and 0 < payload.find(b"\0") < len(payload) - 1:
        at = payload.index(b"\0")
        key, value = "icc", {"keyword": payload[:at], "data": payload[at + 1 :]}
    else:
        return False
    if key in color:
        return False
    color[key] = value
    return True


def _read(data: bytes, strict: bool = False):
    """Everything between the signature and IEND, with diagnostics."""
    state = {"idat": [], "palette": None, "alpha": b"", "frames": [], "plays": None, "count": None, "meta": [], "blocks": [], "payload": 0, "color": {}}
    said: list = []
    say = lambda at, name: said.append(("RecoverableMalformed", "StillDecode", at, name))
    head = None
    ended = at = 0
    trns = False
    for kind, payload, at, good in chunks(data, strict):
        pixels = bool(state["idat"])
        if head is None:
            if kind != b"IHDR":
                raise malformed("IHDR comes first", at, "png_chunk")
            head = header(payload)
            continue
        if not good:
            name = kind.decode("latin1")
            say(at, f"png_{name}_crc" if kind in (b"IDAT", b"IEND", b"acTL", b"fcTL", b"fdAT") else "png_post_idat_crc")
        if kind[2] & 32:
            say(at, "png_reserved_bit")
        if pixels and kind[0] & 32 and kind not in INTERPRETED:
            say(at, "png_ancillary_after_idat")
        if kind == b"IDAT":
            state["idat"].append(payload)
            state["payload"] += len(payload)
            if state["frames"] and state["frames"][-1][2] is None and len(state["frames"]) == 1:
                state["default"] = True
        elif kind == b"PLTE":
            if state["palette"] is not None:
                say(at, "png_duplicate_plte")
            else:
                state["palette"] = payload
                if not payload:
                    say(at, "png_empty_plte")
                elif len(payload) % 3:
                    say(at, "png_partial_plte")
        elif kind == b"tRNS":
            if trns:
                say(at, "png_duplicate_trns")
            else:
                trns, state["alpha"] = True, payload
                if head[3] == 3 and state["palette"] is None:
                    say(at, "png_trns_without_plte")
        elif kind == b"acTL":
            if len(payload) < 8:
                raise malformed("acTL is too short", at, "png_chunk")
            if pixels:
                say(at, "png_actl_after_idat")
            elif state["count"] is not None:
                say(at, "png_duplicate_actl")
            else:
                state["count"], state["plays"] = struct.unpack_from(">II", payload)
                if not state["count"]:
                    say(at, "png_apng_zero_frames")
            if len(payload) > 8:
                say(at, "png_actl_overlong")
        elif kind == b"fcTL":
            if len(payload) != 26:
                raise malformed("fcTL has 26 bytes", at, "png_chunk")
            state["frames"].append([struct.unpack(">IIIIIHHBB", payload), at, None if not pixels else []])
        elif kind == b"fdAT":
            if len(payload) < 4 or not state["frames"]:
                raise malformed("fdAT without fcTL", at, "png_chunk")
            last = state["frames"][-1]
            last[2] = (last[2] or []) + [(struct.unpack_from(">I", payload)[0], payload[4:])]
            state["payload"] += len(payload) - 4
        elif kind == b"IEND":
            ended = at + 12
        elif kind in METADATA or kind in COLOR:
            if lost_metadata(kind, payload, at):
                said.append(("InvalidMetadataIgnored", "StillDecode", at, f"png_{kind.decode()}"))
            elif not keep_color(kind, payload, state["color"]):
                state["meta"].append((kind, payload))
        elif kind[0] & 32:
            state["blocks"].append((kind, payload))
    if head is None:
        raise malformed("no IHDR", 8, "png_chunk")
    if not state["idat"]:
        raise malformed("no image data", at, "png_chunk")
    if not ended:
        say(len(data), "png_missing_iend")
        ended = len(data)
    if head[3] == 3 and state["palette"] is None:
        say(None, "png_missing_plte")
    return head, state, said, ended


def decode(data: bytes) -> Result:
    head, s, said, end = _read(data)
    samples, more = pixels_of(b"".join(s["idat"]), *head)
    if more:
        said.append(("RecoverableMalformed", "StillDecode", None, "png_oversized_scanline"))
    image = build(samples, head[2], head[3], s["palette"], s["alpha"])
    image.metadata, image.blocks, image.color = s["meta"], s["blocks"], s["color"] or None
    return Result(image, end, said)


def blend_byte(fg: np.ndarray, bg: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    t = bg.astype(np.uint32) * (255 - alpha.astype(np.uint32)) + fg.astype(np.uint32) * alpha + 128
    return ((t + (t >> 8)) >> 8).astype(np.uint8)


def decode_sequence(data: bytes) -> Result:
    head, s, said, end = _read(data)
    w, h, depth, color, interlace = head
    if s["count"] is None or not s["frames"]:
        still = decode(data)
        return Result(Sequence(w, h, [Frame(still.value, (0, 0, w, h))], "SingleFrame", "Canvas"), end, still.diagnostics)
    if len(s["frames"]) != s["count"]:
        raise malformed("acTL counts other frames", None, "png_chunk")
    expected, frames, canvas, saved = 0, [], None, None
    for i, (control, at, parts) in enumerate(s["frames"]):
        number, fw, fh, x, y, num, den, dispose, blend = control
        if number != expected:
            raise malformed(f"sequence number {number} for {expected}", at, "png_chunk")
        expected += 1
        if not fw or not fh or x + fw > w or y + fh > h:
            raise malformed("a frame is outside its canvas", at, "png_chunk")
        if parts is None:
            stream = b"".join(s["idat"])
        else:
            for n, _ in parts:
                if n != expected:
                    raise malformed(f"sequence number {n} for {expected}", at, "png_chunk")
                expected += 1
            stream = b"".join(p for _, p in parts)
        part = build(pixels_of(stream, fw, fh, depth, color, interlace)[0], depth, color, s["palette"], s["alpha"])
        own = part.array() if part.mode != "L1" else part.array() // 255
        if canvas is None:
            canvas = np.zeros((h, w, own.shape[2]), own.dtype)
        if dispose == 2 and i:
            saved = canvas.copy()
        box = canvas[y : y + fh, x : x + fw]
        if blend == 1 and i and part.alpha == "Straight" and own.dtype == np.uint8:
            a = own[:, :, -1:] if part.mode != "P8" else _index_alpha(own, s["alpha"])
            own = blend_byte(own, box, a)
        canvas[y : y + fh, x : x + fw] = own
        pixels = pack_bits(canvas[:, :, 0]) if part.mode == "L1" else canvas.tobytes()
        image = Raster(w, h, part.mode, pixels, part.palette, part.palette_alpha, alpha=part.alpha)
        frames.append(Frame(image, (x, y, fw, fh), (num, den or 100), dispose, "Over" if blend else "Source", bool(interlace)))
        if dispose == 1 or (dispose == 2 and not i):
            canvas[y : y + fh, x : x + fw] = 0
        elif dispose == 2:
            canvas = saved
    return Result(Sequence(w, h, frames, "TimedAnimation", "Canvas", s["plays"]), end, said)


def _index_alpha(index: np.ndarray, alpha: bytes) -> np.ndarray:
    table = np.full(256, 255, np.uint8)
    table[: len(alpha)] = np.frombuffer(alpha[:256], np.uint8)
    return table[index]


def verify(data: bytes) -> None:
    """Every chunk's CRC, IHDR first, IDAT and IEND present."""
    kinds = [k for k, *_ in chunks(data, True)]
    if not kinds or kinds[0] != b"IHDR" or b"IDAT" not in kinds or kinds[-1] != b"IEND":
        raise malformed("IHDR, IDAT and IEND are needed", None, "png_chunk")


def metadata_bytes(data: bytes) -> int:
    _, s, _, end = _read(data)
    return end - s["payload"]


def choose_filters(rows: np.ndarray, bpp: int, average: bool) -> bytes:
    """Each row under the filter of the least sum of residual sizes, the first of None, Up, Sub, [Average], Paeth."""
    h, stride = rows.shape
    v = rows.astype(np.int16)
    left, up, corner = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    left[:, bpp:], up[1:], corner[1:, bpp:] = v[:, :-bpp], v[:-1], v[:-1, :-bpp]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    guess = [(0, np.zeros_like(v)), (2, up), (1, left), *([(3, left + up >> 1)] if average else []), (4, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)))]
    residues = np.stack([(v - g) & 255 for _, g in guess]).astype(np.uint8)
    best = np.argmin(np.abs(residues.view(np.int8).astype(np.int32)).sum(axis=2), axis=0)
    kinds = np.array([k for k, _ in guess], np.uint8)[best]
    return np.concatenate([kinds[:, None], residues[best, np.arange(h)]], axis=1).tobytes()


def _chunk(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))


COLOR_OF = {"L1": (0, 1), "L8": (0, 8), "L16": (0, 16), "P8": (3, 8), "La8": (4, 8), "Rgb8": (2, 8), "Rgba8": (6, 8)}


# The ancillary chunks that options ask for.
ANCILLARY = {"gamma": (b"gAMA", struct.pack(">I", 45455)), "srgb": (b"sRGB", b"\0"), "physical": (b"pHYs", struct.pack(">IIB", 2835, 2835, 1)), "text_chunks": (b"tEXt", b"Comment\0rasterloom"), "time": (b"tIME", bytes((7, 234, 7, 4, 0, 0, 0)))}


def encode(image: Raster, compression: int = 6, optimize: bool = False, gamma: bool = False, srgb: bool = False, physical: bool = False, text_chunks: bool = False, time: bool = False) -> bytes:
    """Interlacing is never written. A bilevel raster stays at one bit; a palette keeps plain rows."""
    if image.mode not in COLOR_OF:
        raise unsupported(f"PNG doesn't take {image.mode}")
    image.validate()
    color, depth = COLOR_OF[image.mode]
    if image.mode == "L16":
        body = np.frombuffer(image.pixels, "<u2").astype(">u2").view(np.uint8)
    else:
        body = np.frombuffer(image.pixels, np.uint8)
    rows = body.reshape(image.height, -1)
    bpp = max(1, CHANNELS[color] * depth // 8)
    if image.mode in ("P8", "L1"):
        raw = np.concatenate([np.zeros((image.height, 1), np.uint8), rows], axis=1).tobytes()
    else:
        raw = choose_filters(rows, bpp, optimize)
    if not 0 <= compression <= 9:
        raise CodecError("Parameter", f"compression {compression}")
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", image.width, image.height, depth, color, 0, 0, 0))]
    if image.mode == "P8":
        if not image.palette:
            raise CodecError("Parameter", "an indexed image needs a palette")
        out.append(_chunk(b"PLTE", image.palette))
        if image.palette_alpha:
            out.append(_chunk(b"tRNS", image.palette_alpha))
    out += [_chunk(*ANCILLARY[k]) for k, wanted in zip(ANCILLARY, (gamma, srgb, physical, text_chunks, time), strict=True) if wanted]
    return b"".join([*out, _chunk(b"IDAT", zlib.compress(raw, 9 if optimize else compression)), _chunk(b"IEND", b"")])
