"""Encoder options as pairs of strings, and what the encoders here make of them.

Duplicates are refused before unknown keys, those before values. Every key of the catalog is read and its value
checked; `IGNORED` are keys that are accepted without an effect on what is written."""

from __future__ import annotations

import re
from collections.abc import Callable

from rasterloom.functions.codecs.base import CodecError
from rasterloom.operators.catalog import OPTION_KEYS

TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
Parser = Callable[[str, str], object]


def _wrong(key: str, what: str) -> CodecError:
    return CodecError("Parameter", f"invalid {what} value for `{key}`")


def flag(key: str, value: str) -> bool:
    if value.lower() in TRUE + FALSE:
        return value.lower() in TRUE
    raise _wrong(key, "boolean")


def number(key: str, value: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", value):
        raise _wrong(key, "numeric")
    return int(value)


def data(key: str, value: str) -> bytes:
    if not re.fullmatch("([0-9A-Fa-f]{2})*", value):
        raise _wrong(key, "hex")
    return bytes.fromhex(value)


def one_of(**names: object) -> Parser:
    def parse(key: str, value: str) -> object:
        if value in names:
            return names[value]
        raise CodecError("Parameter", f"invalid `{key}` option")

    return parse


def _level(key: str, value: str) -> int:
    return {"none": 0, "default": 6, "max": 9}.get(value) if value in ("none", "default", "max") else number(key, value)


def _loop(key: str, value: str) -> int | None:
    return None if value == "false" else 0 if value in ("true", "infinite") else number(key, value)


def _sizes(key: str, value: str) -> tuple[int, int]:
    found = [int(x) for x in re.findall("[0-9]+", value)]
    if len(found) != 2:
        raise CodecError("Parameter", "sizes are one pair of width and height")
    return found[0], found[1]


_SAMPLING = {"444": "4:4:4", "422": "4:2:2", "420": "4:2:0"}
PARSERS: dict[str, dict[str, tuple[Parser, str | None]]] = {
    "JPEG": {"quality": (number, "quality"), "progressive": (flag, "progressive"), "optimize": (flag, "optimize"), "subsampling": (one_of(**_SAMPLING, **{v: v for v in _SAMPLING.values()}), "subsampling"), "restart_interval": (number, "restart_rows"), "exif_hex": (data, "exif")},
    "PNG": {"compression": (_level, "compression"), "optimize": (flag, "optimize"), **{k: (flag, None) for k in ("interlace", "interlaced")}, **{k: (flag, k) for k in ("gamma", "srgb", "physical", "text_chunks", "time")}},
    "GIF": {"interlace": (flag, "interlace"), "interlaced": (flag, "interlace"), "animated": (flag, "animated"), "transparency": (flag, "transparency"), "loop": (_loop, "loops"), "color_table": (one_of(**{"global": 0, "local": 1}), "color_table"), "disposal": (one_of(**{"none": 0, "0": 0, "keep": 1, "1": 1, "background": 2, "2": 2, "previous": 3, "3": 3}), "disposal")},
    "BMP": {},
    "TIFF": {"compression": (one_of(none="none", raw="none", lzw="lzw", tiff_lzw="lzw", deflate="deflate", tiff_adobe_deflate="deflate", packbits="packbits"), "compression"), "predictor": (one_of(**{"none": False, "1": False, "horizontal": True, "2": True}), "predictor")},
    "WEBP": {"lossless": (flag, None), **{k: (number, None) for k in ("quality", "method", "kmax", "kmin")}, **{k: (data, None) for k in ("icc_hex", "exif_hex", "xmp_hex")}, **{k: (flag, None) for k in ("minimize_size", "allow_mixed")}},
    "ICO": {"entry_type": (one_of(png="png", bmp="bmp"), "entry_type"), "sizes": (_sizes, "sizes")},
    "AVIF": {"quality": (number, None), "codec": (one_of(auto=0, aom=1), None), "subsampling": (one_of(**{"4:4:4": 0, "4:2:2": 1, "4:2:0": 2, "4:0:0": 3}), None), "range": (one_of(full=0, limited=1), None), **{k: (number, None) for k in ("speed", "max_threads", "tile_rows", "tile_cols", "exif_orientation", "sequence_time")}, **{k: (flag, None) for k in ("alpha_premultiplied", "autotiling")}, **{k: (data, None) for k in ("icc_hex", "exif_hex", "xmp_hex")}},
}
IGNORED = {f: tuple(k for k, (_, target) in keys.items() if target is None) for f, keys in PARSERS.items()}
assert all(set(PARSERS[f]) == set(keys) for f, keys in OPTION_KEYS.items())


def from_pairs(fmt: str, pairs: list[tuple[str, str]]) -> dict[str, object]:
    """Keyword arguments of the format's encoder."""
    seen: set[str] = set()
    for key, _ in pairs:
        if key in seen:
            raise CodecError("Parameter", f"duplicate legacy encode option `{key}`")
        seen.add(key)
    out = {}
    for key, value in pairs:
        if key not in PARSERS[fmt]:
            raise CodecError("Parameter", f"unknown legacy encode option `{key}`")
        parse, target = PARSERS[fmt][key]
        found = parse(key, value)
        if target:
            out[target] = found
    return out
