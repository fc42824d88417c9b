"""Dispatch over the codecs: detection, inspection, decoding, verification and encoding of one blob."""

from __future__ import annotations

from rasterloom.functions.codecs import avif, bmp, gif, ico, jpeg, png, tiff, webp
from rasterloom.functions.codecs.base import CodecError, Frame, Info, NeedMore, Raster, Result, Sequence

CODECS = {"JPEG": jpeg, "PNG": png, "GIF": gif, "BMP": bmp, "WEBP": webp, "TIFF": tiff, "ICO": ico, "AVIF": avif}
# Signatures, in the order of detection.
TIFF_STARTS = (b"MM\0*", b"II*\0", b"MM*\0", b"II\0*", b"MM\0+", b"II+\0")


def detect(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "JPEG"
    if data[:8] == png.SIGNATURE:
        return "PNG"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF"
    if data[:2] == b"BM":
        return "BMP"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and data[12:16] in (b"VP8 ", b"VP8L", b"VP8X"):
        return "WEBP"
    if data[:4] in TIFF_STARTS:
        return "TIFF"
    if data[:4] in (b"\0\0\1\0", b"\0\0\2\0"):
        return "ICO"
    if data[4:12] in (b"ftypavif", b"ftypavis"):
        return "AVIF"
    if data[4:12] in (b"ftypmif1", b"ftypmsf1"):
        n = int.from_bytes(data[:4], "big")
        if 20 <= n <= len(data) and n % 4 == 0 and any(data[i : i + 4] in (b"avif", b"avis") for i in range(16, n, 4)):
            return "AVIF"
    return None


def format_of(data: bytes, wanted: str | None = None) -> str:
    found = detect(data)
    if found is None:
        raise CodecError("Malformed", f"no {wanted} signature") if wanted else CodecError("UnknownFormat", "unknown image format")
    if wanted and found != wanted:
        raise CodecError("Parameter", f"{found} data for {wanted}")
    return found


def inspect(data: bytes, wanted: str | None = None, count_frames: bool = True) -> tuple[str, Info]:
    """Without count_frames, formats whose frames take a walk through the whole blob report none (0)."""
    fmt = format_of(data, wanted)
    basic = getattr(CODECS[fmt], "inspect_basic", None)
    return fmt, basic(data) if basic and not count_frames else CODECS[fmt].inspect(data)


def _trailing(r: Result, data: bytes, stage: str) -> Result:
    if r.consumed < len(data):
        r.diagnostics.append(("TrailingDataIgnored", stage, r.consumed, "trailing_input"))
    return r


def decode(data: bytes, wanted: str | None = None) -> tuple[str, Result]:
    fmt = format_of(data, wanted)
    return fmt, _trailing(CODECS[fmt].decode(data), data, "StillDecode")


def decode_sequence(data: bytes, wanted: str | None = None) -> tuple[str, Result]:
    fmt = format_of(data, wanted)
    codec = CODECS[fmt]
    if hasattr(codec, "decode_sequence"):
        return fmt, _trailing(codec.decode_sequence(data), data, "SequenceDecode")
    r = codec.decode(data)
    w, h = r.value.width, r.value.height
    return fmt, _trailing(Result(Sequence(w, h, [Frame(r.value, (0, 0, w, h))], "SingleFrame", "Canvas"), r.consumed, r.diagnostics), data, "SequenceDecode")


def decode_frame(data: bytes, index: int, wanted: str | None = None) -> tuple[str, Result]:
    """The sequence with one of its frames alone, at its place; a TIFF page is read without the others."""
    fmt = format_of(data, wanted)
    if fmt == "TIFF":
        image, count = tiff.decode_page(data, index)
        r = Result(Sequence(image.width, image.height, [Frame(image, (0, 0, image.width, image.height))], "UntimedPages" if count > 1 else "SingleFrame", "Page"), len(data))
        return fmt, r
    fmt, r = decode_sequence(data, wanted)
    if not 0 <= index < len(r.value.frames):
        raise CodecError("Parameter", f"there is no frame {index}")
    r.value.frames = [r.value.frames[index]]
    return fmt, r


def verify(data: bytes) -> str:
    """Structure for PNG, JPEG and WebP, the header for the others; returns the format."""
    fmt = format_of(data)
    getattr(CODECS[fmt], "verify", CODECS[fmt].inspect)(data)
    return fmt


def metadata_bytes(data: bytes) -> int:
    return CODECS[format_of(data)].metadata_bytes(data)


def encode(image: Raster, fmt: str, **options) -> bytes:
    if fmt == "AVIF" or fmt not in CODECS:
        raise CodecError("Unsupported", f"{fmt} isn't encoded", reason="NotImplemented")
    try:
        return CODECS[fmt].encode(image, **options)
    except TypeError as e:
        raise CodecError("Parameter", str(e)) from e


def plain_still(seq: Sequence) -> bool:
    """Whether a still encoder may take the sequence: one frame that has no animation facts."""
    if len(seq.frames) != 1:
        return False
    f = seq.frames[0]
    whole = f.rect == (0, 0, seq.width, seq.height)
    timed = f.duration is not None and f.duration[0] != 0
    return whole and not (timed or f.disposal or f.blend or f.interlaced or f.default_image or seq.loops is not None or seq.background is not None)


def encode_sequence(seq: Sequence, fmt: str, **options) -> bytes:
    """GIF, TIFF and WebP; another format takes a plain still."""
    codec = CODECS.get(fmt)
    if fmt != "AVIF" and hasattr(codec, "encode_sequence"):
        return codec.encode_sequence(seq, **options)
    if not plain_still(seq):
        raise CodecError("Unsupported", f"{fmt} has no sequences", reason="NotImplemented")
    return encode(seq.frames[0].image, fmt, **options)


__all__ = ["CODECS", "CodecError", "Frame", "Info", "NeedMore", "Raster", "Result", "Sequence", "decode", "decode_frame", "decode_sequence", "detect", "encode", "encode_sequence", "format_of", "inspect", "metadata_bytes", "plain_still", "verify"]
