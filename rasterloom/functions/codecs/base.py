"""Rasters, frames and errors that all codecs share."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BYTES = {"L8": 1, "P8": 1, "La8": 2, "L16": 2, "Rgb8": 3, "Rgba8": 4, "Cmyk8": 4, "La16": 4, "F32": 4, "I32": 4, "Rgb16": 6, "Rgba16": 8, "Rgb32F": 12, "Rgba32F": 16}
MAX_PIXELS, MAX_SIDE = 178_956_970, 16_384


class CodecError(Exception):
    """A failure of one blob; it becomes the error column of its row."""

    def __init__(self, kind: str, message: str, *, reason: str | None = None, offset: int | None = None, identity: str | None = None, minimum: int | None = None, resource: str | None = None, maximum: int | None = None, observed: int | None = None):
        super().__init__(message)
        self.kind, self.message, self.reason, self.offset, self.identity = kind, message, reason, offset, identity
        self.minimum, self.resource, self.maximum, self.observed = minimum, resource, maximum, observed


def malformed(message: str, offset: int | None = None, identity: str | None = None) -> CodecError:
    return CodecError("Malformed", message, offset=offset, identity=identity)


def unsupported(message: str, offset: int | None = None, identity: str | None = None, reason: str = "NotImplemented") -> CodecError:
    return CodecError("Unsupported", message, offset=offset, identity=identity, reason=reason)


class NeedMore(CodecError):
    def __init__(self, minimum: int, offset: int | None = None, identity: str | None = None):
        super().__init__("NeedMoreData", f"{minimum} bytes are needed", offset=offset, identity=identity, minimum=minimum)


@dataclass
class Raster:
    """Tightly packed, row-major, interleaved samples; 16-bit ones little-endian, L1 eight in a byte."""

    width: int
    height: int
    mode: str
    pixels: bytes
    palette: bytes | None = None
    palette_alpha: bytes = b""
    hotspot: tuple[int, int] | None = None
    alpha: str | None = None
    byte_order: str | None = None
    blocks: list[tuple[bytes, bytes]] = field(default_factory=list)
    metadata: list[tuple[bytes, bytes]] = field(default_factory=list)
    color: dict | None = None

    def validate(self) -> Raster:
        if self.width <= 0 or self.height <= 0:
            raise CodecError("Dimensions", "a raster needs a width and a height")
        if len(self.pixels) != raster_bytes(self.mode, self.width, self.height):
            raise CodecError("Parameter", f"{len(self.pixels)} bytes are no {self.width} x {self.height} {self.mode} raster")
        if self.palette is not None and (len(self.palette) % 3 or not 3 <= len(self.palette) <= 768 or len(self.palette_alpha) > len(self.palette) // 3):
            raise CodecError("Parameter", "a palette has 1 to 256 RGB entries and no more alphas")
        return self

    def array(self) -> np.ndarray:
        """(height, width, channels) of bytes; L1 as 0 or 255, 16-bit samples as uint16."""
        if self.mode == "L1":
            bits = np.unpackbits(np.frombuffer(self.pixels, np.uint8).reshape(self.height, -1), axis=1)[:, : self.width]
            return (bits * np.uint8(255))[:, :, None]
        kind = np.dtype("<u2") if self.mode in ("L16", "La16", "Rgb16", "Rgba16") else np.uint8
        return np.frombuffer(self.pixels, kind).reshape(self.height, self.width, -1)

    def rgba(self) -> np.ndarray:
        """(height, width, 4) bytes."""
        a = self.array()
        full = np.full(a.shape[:2] + (1,), 255, np.uint8)
        if self.mode == "P8":
            colors = np.zeros((256, 4), np.uint8)
            rgb = np.frombuffer(self.palette or b"", np.uint8).reshape(-1, 3)
            colors[:, 3] = 255
            colors[: len(rgb), :3] = rgb
            colors[: len(self.palette_alpha), 3] = np.frombuffer(self.palette_alpha, np.uint8)
            return colors[a[:, :, 0]]
        if self.mode in ("L1", "L8"):
            return np.concatenate([a, a, a, full], axis=2)
        if self.mode == "L16":
            g = (a >> 8).astype(np.uint8)
            return np.concatenate([g, g, g, full], axis=2)
        if self.mode == "La8":
            return np.concatenate([a[:, :, :1]] * 3 + [a[:, :, 1:]], axis=2)
        if self.mode == "Rgb8":
            return np.concatenate([a, full], axis=2)
        if self.mode == "Rgba8":
            return a
        if self.mode == "Cmyk8":
            c = 255 - a.astype(np.int32)
            return np.concatenate([((c[:, :, :3] * c[:, :, 3:] + 127) // 255).astype(np.uint8), full], axis=2)
        raise unsupported(f"{self.mode} has no 8-bit colours")


def raster_bytes(mode: str, width: int, height: int) -> int:
    return (width + 7) // 8 * height if mode == "L1" else width * height * BYTES[mode]


@dataclass
class Info:
    width: int
    height: int
    mode: str
    bit_depth: int = 8
    frames: int = 1
    animated: bool = False
    hotspot: tuple[int, int] | None = None
    byte_order: str | None = None


@dataclass
class Frame:
    image: Raster
    rect: tuple[int, int, int, int]
    duration: tuple[int, int] | None = None
    disposal: int = 0
    blend: str | None = None
    interlaced: bool = False
    default_image: bool = False


@dataclass
class Sequence:
    width: int
    height: int
    frames: list[Frame]
    kind: str
    layout: str
    loops: int | None = None
    background: tuple[int, ...] | None = None


@dataclass
class Result:
    value: object
    consumed: int
    diagnostics: list[tuple[str, str, int | None, str]] = field(default_factory=list)


def check_pixels(width: int, height: int, limit: int = MAX_PIXELS) -> None:
    if width <= 0 or height <= 0:
        raise CodecError("Dimensions", "the image has no pixels")
    if width * height > limit:
        raise CodecError("Dimensions", f"{width} x {height} is over {limit} pixels")


def need(data: bytes, end: int, offset: int, identity: str) -> None:
    if end > len(data):
        raise NeedMore(end, offset, identity)


def pack_bits(bits: np.ndarray) -> bytes:
    """Rows of 0/1 to bytes, the first sample in the high bit."""
    return np.packbits(bits.astype(np.uint8), axis=1).tobytes()


def unpack(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Rows of bytes to samples of 1, 2, 4 or 8 bits."""
    if bits == 8:
        return rows[:, :width]
    steps = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((rows[:, :, None] >> steps) & ((1 << bits) - 1)).reshape(len(rows), -1)[:, :width]
