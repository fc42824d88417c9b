"""AVIF at container level: boxes, items, properties, references, tracks, AV1 units. Pixels are not decoded."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from rasterloom.functions.codecs.base import Info, NeedMore, Result, check_pixels, malformed, unsupported

MAX_BOXES, MAX_PROPERTIES = 4096, 2048
PARENTS = (b"meta", b"iprp", b"ipco", b"dinf", b"moov", b"trak", b"mdia", b"minf", b"stbl")


def boxes(data: bytes, at: int = 0, end: int | None = None, path: str = "", depth: int = 0) -> list[tuple[str, int, int, int]]:
    """(path, box offset, payload offset, box end) of all boxes, parents before children."""
    out: list = []
    end = len(data) if end is None else end
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if n == 1:
            if at + 16 > end:
                raise NeedMore(at + 16, at, "avif_box")
            n, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if n == 0 else at + n
        if stop > end:
            if not depth:
                raise NeedMore(stop, at, "avif_box")
            raise malformed("a box is longer than its parent", at, "avif_box")
        if stop < body:
            raise malformed("a box is shorter than its header", at, "avif_box")
        name = f"{path}/{kind.decode('latin1')}"
        out.append((name, at, body, stop))
        if kind in PARENTS and depth < 8:
            out += boxes(data, body + (4 if kind == b"meta" else 0), stop, name, depth + 1)
        if len(out) > MAX_BOXES:
            raise malformed("too many boxes", at, "avif_box")
        at = stop
    return out


@dataclass
class Items:
    primary: int | None = None
    kinds: dict[int, str] = field(default_factory=dict)
    properties: list[tuple[str, bytes]] = field(default_factory=list)
    associations: list[tuple[int, int, bool]] = field(default_factory=list)
    edges: list[tuple[str, int, int]] = field(default_factory=list)
    extents: list[tuple[int, int, int]] = field(default_factory=list)

    def of(self, item: int, kind: str) -> bytes | None:
        for i, p, _ in self.associations:
            if i == item and 0 < p <= len(self.properties) and self.properties[p - 1][0] == kind:
                return self.properties[p - 1][1]
        return None


def items(data: bytes) -> tuple[Items, list]:
    if len(data) < 12:
        raise NeedMore(12, 0, "avif_box")
    found = boxes(data)
    if not found or found[0][0] != "/ftyp":
        raise malformed("no file type box", 0, "avif_box")
    out = Items()
    for name, _, at, end in found:
        b = data[at:end]
        try:
            if name == "/meta/pitm":
                out.primary = struct.unpack_from(">H" if b[0] == 0 else ">I", b, 4)[0]
            elif name.startswith("/meta/iprp/ipco/"):
                out.properties.append((name[-4:], b))
                if len(out.properties) > MAX_PROPERTIES:
                    raise malformed("too many properties", at, "avif_box")
            elif name == "/meta/iinf":
                for sub, _, x, stop in boxes(data, at + (6 if b[0] == 0 else 8), end, "", 7):
                    e = data[x:stop]
                    if sub == "/infe" and e[0] in (2, 3):
                        ident, kind = struct.unpack_from(">H2x4s" if e[0] == 2 else ">I2x4s", e, 4)
                        out.kinds[ident] = kind.decode("latin1")
            elif name == "/meta/iprp/ipma":
                _associations(b, out)
            elif name == "/meta/iref":
                wide = ">I" if b[0] else ">H"
                size = struct.calcsize(wide)
                for sub, _, x, stop in boxes(data, at + 4, end, "", 7):
                    e = data[x:stop]
                    source, n = struct.unpack_from(wide, e)[0], struct.unpack_from(">H", e, size)[0]
                    out.edges += [(sub[1:], source, struct.unpack_from(wide, e, size + 2 + size * k)[0]) for k in range(n)]
            elif name == "/meta/iloc":
                _extents(b, out)
        except (struct.error, IndexError) as e:
            raise malformed(f"{name} ends early", at, "avif_box") from e
    return out, found


def _associations(b: bytes, out: Items) -> None:
    wide = b[3] & 1
    at = 8
    for _ in range(struct.unpack_from(">I", b, 4)[0]):
        item = struct.unpack_from(">I" if b[0] else ">H", b, at)[0]
        at += 4 if b[0] else 2
        n, at = b[at], at + 1
        for _ in range(n):
            v = struct.unpack_from(">H" if wide else ">B", b, at)[0]
            at += 2 if wide else 1
            top = 0x8000 if wide else 0x80
            out.associations.append((item, v & (top - 1), bool(v & top)))


def _extents(b: bytes, out: Items) -> None:
    version, sizes = b[0], struct.unpack_from(">BB", b, 4)
    off, length, base, index = sizes[0] >> 4, sizes[0] & 15, sizes[1] >> 4, sizes[1] & 15 if version else 0
    number = lambda at, n: int.from_bytes(b[at : at + n], "big")
    n, at = (struct.unpack_from(">H", b, 6)[0], 8) if version < 2 else (struct.unpack_from(">I", b, 6)[0], 10)
    for _ in range(n):
        item = number(at, 2 if version < 2 else 4)
        at += (2 if version < 2 else 4) + (2 if version else 0) + 2
        start = number(at, base)
        at += base
        m, at = number(at, 2), at + 2
        for _ in range(m):
            at += index
            out.extents.append((item, start + number(at, off), number(at + off, length)))
            at += off + length


def properties(data: bytes) -> list[tuple[int, str, bool, list[int] | None, str | None]]:
    """(item, kind, essential, numbers, text) of every association, with what the known kinds say.

    ispe: width, height; pixi: bits of each channel; irot: quarter turns; imir: axis; pasp: two sides; clap: eight
    numbers; colr: its type as text and, of nclx, primaries, transfer, matrix and range; auxC: its name; av1C:
    profile, level, bits, monochrome and subsampling flags."""
    out, _ = items(data)
    rows = []
    for item, place, essential in out.associations:
        if not 0 < place <= len(out.properties):
            continue
        kind, b = out.properties[place - 1]
        numbers = text = None
        try:
            if kind == "ispe":
                numbers = list(struct.unpack_from(">II", b, 4))
            elif kind == "pixi":
                numbers = list(b[5 : 5 + b[4]])
            elif kind in ("irot", "imir"):
                numbers = [b[0] & (3 if kind == "irot" else 1)]
            elif kind in ("pasp", "clap"):
                numbers = list(struct.unpack_from(">II" if kind == "pasp" else ">8I", b))
            elif kind == "colr":
                text = b[:4].decode("latin1")
                numbers = [*struct.unpack_from(">HHH", b, 4), b[10] >> 7] if text == "nclx" else None
            elif kind == "auxC":
                text = b[4:].split(b"\0")[0].decode("latin1")
            elif kind == "av1C":
                numbers = [b[1] >> 5, b[1] & 31, 8 if not b[2] & 0x40 else 12 if b[2] & 0x20 else 10, b[2] >> 4 & 1, b[2] >> 3 & 1, b[2] >> 2 & 1]
        except (struct.error, IndexError) as e:
            raise malformed(f"{kind} ends early", None, "avif_box") from e
        rows.append((item, kind, essential, numbers, text))
    return rows


def samples(data: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """(track, sample, offset, size, time, duration) from the sample tables of every track, times in its own units."""
    tables: list[dict] = []
    for name, _, at, end in boxes(data):
        b = data[at:end]
        if name == "/moov/trak":
            tables.append({})
        elif name.startswith("/moov/trak/mdia/minf/stbl/") and tables:
            tables[-1][name[-4:]] = b
    rows = []
    for track, t in enumerate(tables):
        try:
            rows += [(track, *x) for x in _samples(t)]
        except (struct.error, KeyError) as e:
            raise malformed("a sample table is missing or ends early", None, "avif_box") from e
    return rows


def _table(b: bytes, record: str) -> list[tuple]:
    n, size = struct.unpack_from(">I", b, 4)[0], struct.calcsize(record)
    if n * size > len(b) - 8:
        raise malformed("a table ends early", None, "avif_box")
    return list(struct.iter_unpack(record, b[8 : 8 + n * size]))


def _samples(t: dict) -> list[tuple[int, int, int, int, int]]:
    same, n = struct.unpack_from(">II", t["stsz"], 4)
    if not same and 12 + 4 * n > len(t["stsz"]):
        raise malformed("a table ends early", None, "avif_box")
    sizes = [same] * min(n, MAX_SAMPLES) if same else [x for (x,) in struct.iter_unpack(">I", t["stsz"][12 : 12 + 4 * n])]
    chunks = [x for (x,) in (_table(t["co64"], ">Q") if "co64" in t else _table(t["stco"], ">I"))]
    runs = _table(t["stsc"], ">III")
    per = [0] * len(chunks)
    for (first, each, _), following in zip(runs, [*(r[0] for r in runs[1:]), len(chunks) + 1], strict=True):
        for c in range(max(first, 1), min(following, len(chunks) + 1)):
            per[c - 1] = each
    times = (d for n, d in _table(t["stts"], ">II") for _ in range(min(n, MAX_SAMPLES)))
    rows, i, time = [], 0, 0
    for at, each in zip(chunks, per, strict=True):
        for _ in range(each):
            if i == len(sizes):
                return rows
            d = next(times, 0)
            rows.append((i, at, sizes[i], time, d))
            at, time, i = at + sizes[i], time + d, i + 1
    return rows


MAX_SAMPLES = 1 << 20


def obus(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(type, temporal layer, spatial layer, payload offset, payload size) of the units of an AV1 stream."""
    out, at = [], 0
    while at < len(data):
        head = data[at]
        if head & 0x80:
            raise malformed("a forbidden bit is set", at, "av1_obu")
        extended, sized = head >> 2 & 1, head >> 1 & 1
        if at + 1 + extended > len(data):
            raise NeedMore(at + 1 + extended, at, "av1_obu")
        layers = data[at + 1] if extended else 0
        body = at + 1 + extended
        size = len(data) - body
        if sized:
            size = shift = 0
            while True:
                if body >= len(data) or shift > 49:
                    raise malformed("a size ends early", at, "av1_obu")
                size |= (data[body] & 127) << shift
                body, shift = body + 1, shift + 7
                if not data[body - 1] & 128:
                    break
        if body + size > len(data):
            raise NeedMore(body + size, at, "av1_obu")
        out.append((head >> 3 & 15, layers >> 5, layers >> 3 & 3, body, size))
        at = body + size
    return out


def sequence_header(payload: bytes) -> dict[str, int]:
    """Profile, still and reduced flags, first level, and largest width and height of a sequence header."""
    value, left = int.from_bytes(payload, "big"), 8 * len(payload)

    def bits(n: int) -> int:
        nonlocal left
        left -= n
        if left < 0:
            raise malformed("a sequence header ends early", None, "av1_obu")
        return value >> left & (1 << n) - 1

    out = {"profile": bits(3), "still": bits(1), "reduced": bits(1)}
    if out["reduced"]:
        out["level"] = bits(5)
    else:
        delay = 0
        if bits(1):
            bits(64)
            if bits(1):
                zeros = 0
                while not bits(1):
                    zeros += 1
                bits(min(zeros, 32) if zeros < 32 else 0)
            if bits(1):
                delay = bits(5) + 1
                bits(42)
        modelled, shown = delay > 0, bits(1)
        for i in range(bits(5) + 1):
            bits(12)
            level = bits(5)
            out.setdefault("level", level)
            if level > 7:
                bits(1)
            if modelled and bits(1):
                bits(2 * delay + 1)
            if shown and bits(1):
                bits(4)
    wide, high = bits(4) + 1, bits(4) + 1
    out["width"], out["height"] = bits(wide) + 1, bits(high) + 1
    return out


def inspect(data: bytes) -> Info:
    out, _ = items(data)
    if out.primary is None:
        raise malformed("no primary item", 0, "avif_box")
    size = out.of(out.primary, "ispe")
    if size is None or len(size) < 12:
        raise malformed("the primary item has no size", 0, "avif_box")
    w, h = struct.unpack_from(">II", size, 4)
    check_pixels(w, h)
    config = out.of(out.primary, "av1C")
    depth = 8 if config is None or len(config) < 3 or not config[2] & 0x40 else 12 if config[2] & 0x20 else 10
    alpha = any(k == "auxl" and target == out.primary for k, _, target in out.edges)
    return Info(w, h, "Rgba8" if alpha else "Rgb8", depth)


def metadata_bytes(data: bytes) -> int:
    """Bytes outside the union of the items' extents."""
    out, found = items(data)
    covered, last = 0, 0
    for s, e in sorted((s, s + n) for _, s, n in out.extents):
        covered += max(0, e - max(s, last))
        last = max(last, e)
    return found[-1][3] - covered if found else 0


def decode(data: bytes) -> Result:
    inspect(data)
    raise unsupported("AV1 pixels")
