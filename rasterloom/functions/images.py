"""Codec operators on DataFrames with a BINARY column: Arrow batches in, an envelope a row out.

Rows are independent, so nothing shuffles; a failure is a value of its row. Policies' checks on encoded bytes
and formats are Catalyst predicates ahead of Python (see operators.policy), those on sizes follow inspection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.functions import codecs, schema
from rasterloom.functions.codecs.base import CodecError, Frame, Raster, Sequence, raster_bytes
from rasterloom.operators import catalog
from rasterloom.operators.policy import DecodePolicy


def error_row(e: Exception, stage: str, fmt: str | None = None) -> dict:
    if not isinstance(e, CodecError):
        e = CodecError("Malformed", f"{type(e).__name__}: {e}")
    kind = e.kind
    return {"kind": kind, "format": fmt, "message": e.message, "stage": stage, "reason": e.reason, "offset": e.offset, "identity": e.identity, "resource": e.resource, "maximum": e.maximum, "observed": e.observed, "minimum": e.minimum}


def _final(e: CodecError, prefix: bool) -> CodecError:
    """Missing bytes are worth waiting for in a prefix only."""
    if e.kind == "NeedMoreData" and not prefix:
        return CodecError("Malformed", e.message, offset=e.offset, identity=e.identity)
    return e


def image_value(fmt: str, r: Raster) -> dict:
    pairs = lambda xs: [{"kind": k, "data": d} for k, d in xs]
    hot = {"x": r.hotspot[0], "y": r.hotspot[1]} if r.hotspot else None
    color = {"srgb_intent": None, "gamma": None, "chromaticities": None, "icc": None, **r.color} if r.color else None
    return {"format": fmt, "width": r.width, "height": r.height, "mode": r.mode, "pixels": r.pixels, "color": color, "palette_rgb": r.palette, "palette_alpha": r.palette_alpha if r.palette else None, "cursor_hotspot": hot, "alpha": r.alpha, "byte_order": r.byte_order, "blocks": pairs(r.blocks), "metadata": pairs(r.metadata)}


def raster_of(v: dict) -> Raster:
    return Raster(v["width"], v["height"], v["mode"], v["pixels"], v.get("palette_rgb"), v.get("palette_alpha") or b"")


def _said(diagnostics: list) -> list[dict]:
    return [dict(zip(("kind", "stage", "offset", "identity"), d, strict=True)) for d in diagnostics]


def _check(policy: DecodePolicy | None, info, fmt: str, data: bytes, frames: int | None) -> None:
    """Canvas limits in their order; encoded bytes and formats come first."""
    if policy is None:
        return
    checks = [("EncodedBytes", policy.max_encoded_bytes, len(data))]
    if policy.formats is not None and fmt not in policy.formats:
        if policy.max_encoded_bytes is None or len(data) <= policy.max_encoded_bytes:
            raise CodecError("Unsupported", f"{fmt} isn't allowed", reason="PolicyDenied")
    if policy.max_metadata_bytes is not None:
        checks.append(("MetadataBytes", policy.max_metadata_bytes, codecs.metadata_bytes(data)))
    checks += [("Width", policy.max_width, info.width), ("Height", policy.max_height, info.height), ("Pixels", policy.max_pixels, info.width * info.height), ("PrimaryDecodedBytes", policy.max_primary_bytes, raster_bytes(info.mode, info.width, info.height)), ("Frames", policy.max_frames, frames)]
    for name, most, n in checks:
        if most is not None and n is not None and n > most:
            raise CodecError("LimitExceeded", f"{n} is over {most}", resource=name, maximum=most, observed=n)


def _inspect(count_frames: bool) -> Callable:
    def run(data: bytes, wanted: str | None, policy: DecodePolicy | None) -> Iterator[dict]:
        fmt, i = codecs.inspect(data, wanted, count_frames)
        _check(policy, i, fmt, data, i.frames or None)
        hot = {"x": i.hotspot[0], "y": i.hotspot[1]} if i.hotspot else None
        yield {"value": {"format": fmt, "width": i.width, "height": i.height, "mode": i.mode, "bit_depth": i.bit_depth, "frame_count": i.frames or None, "is_animated": i.animated, "cursor_hotspot": hot, "byte_order": i.byte_order, "decoded_bytes": raster_bytes(i.mode, i.width, i.height)}}

    return run


def _decode(data: bytes, wanted: str | None, policy: DecodePolicy | None) -> Iterator[dict]:
    if policy:
        fmt, i = codecs.inspect(data, wanted)
        _check(policy, i, fmt, data, 1)
    fmt, r = codecs.decode(data, wanted)
    yield {"value": image_value(fmt, r.value), "consumed_bytes": r.consumed, "diagnostics": _said(r.diagnostics)}


def charge(policy: DecodePolicy | None, sizes: list[int]) -> None:
    """The sequence budget: the primary frame is charged to the sum first, a later one meets its own limit before it."""
    total = 0
    for n, size in enumerate(sizes):
        total += size
        for resource, most, spent in (("FrameDecodedBytes", policy.max_frame_bytes if n else None, size), ("SequenceDecodedBytes", policy.max_sequence_bytes, total)) if policy else ():
            if most is not None and spent > most:
                raise CodecError("LimitExceeded", f"{spent} is over {most}", resource=resource, maximum=most, observed=spent)


def _frames(index: int | None) -> Callable:
    def run(data: bytes, wanted: str | None, policy: DecodePolicy | None) -> Iterator[dict]:
        if policy:
            fmt, i = codecs.inspect(data, wanted)
            _check(policy, i, fmt, data, i.frames)
            if i.frames == 1:
                charge(policy, [raster_bytes(i.mode, i.width, i.height)])  # before any pixel
        fmt, r = codecs.decode_sequence(data, wanted) if index is None else codecs.decode_frame(data, index, wanted)
        s: Sequence = r.value
        charge(policy, [len(f.image.pixels) for f in s.frames])
        for n, f in enumerate(s.frames):
            rect = dict(zip(("left", "top", "width", "height"), f.rect, strict=True))
            d = {"num": f.duration[0], "den": f.duration[1]} if f.duration else None
            value = {"frame_index": n if index is None else index, "frame_count": len(s.frames), "kind": s.kind, "layout": s.layout, "canvas_width": s.width, "canvas_height": s.height, "loop_count": s.loops, "rect": rect, "duration": d, "disposal": f.disposal, "blend": f.blend, "interlaced": f.interlaced, "image": image_value(fmt, f.image)}
            yield {"value": value, "consumed_bytes": r.consumed, "diagnostics": _said(r.diagnostics) if not n else []}

    return run


def _verify(data: bytes, wanted: str | None, policy: DecodePolicy | None) -> Iterator[dict]:
    yield {"value": codecs.verify(data)}


PART_BYTES = 32_000_000


def _weight(value) -> int:
    image = value.get("image", value) if isinstance(value, dict) else {}
    return len(image.get("pixels") or b"")


def _apply(df: DataFrame, content: str, value: str, stage: str, work: Callable, wanted: str | None, policy: DecodePolicy | None, prefix: bool, features: tuple[str, ...] | None = None) -> DataFrame:
    """df with the envelope's columns instead of `content`; other columns stay. `features` names the formats that
    are switched on (None: all). Rows go on in parts of about PART_BYTES of results."""
    keep = [f for f in df.schema.fields if f.name != content]
    out = StructType(keep + StructType.fromDDL(schema.envelope(value)).fields)
    names = [f.name for f in keep]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(content)
            rest = {n: batch.column(batch.schema.get_field_index(n)) for n in names}

            def part(rows: list, index: list, rest: dict = rest) -> pa.RecordBatch:
                picked = [rest[n].take(pa.array(index, pa.int64())) for n in names]
                own = [pa.array([r.get(f.name) for r in rows], f.type) for f in list(arrow)[len(names) :]]
                return pa.RecordBatch.from_arrays(picked + own, schema=arrow)

            rows, index, size = [], [], 0
            for n, data in enumerate(batch.column(at).to_pylist()):
                try:
                    if data is None:
                        raise CodecError("UnknownFormat", "no data")
                    if features is not None and codecs.format_of(data, wanted) not in features:
                        raise CodecError("Unsupported", f"{codecs.detect(data)} is switched off", reason="FeatureDisabled")
                    found = [{"ok": True, "diagnostics": [], **x} for x in work(data, wanted, policy)]
                except Exception as e:  # any failure is this row's error
                    found = [{"ok": False, "diagnostics": [], "error": error_row(_final(e, prefix) if isinstance(e, CodecError) else e, stage, codecs.detect(data) if data is not None else None)}]
                rows += found
                index += [n] * len(found)
                size += sum(_weight(x.get("value")) for x in found)
                if size > PART_BYTES:
                    yield part(rows, index)
                    rows, index, size = [], [], 0
            if rows:
                yield part(rows, index)

    return df.mapInArrow(run, out)


def inspect_images(df: DataFrame, content: str = "content", fmt: str | None = None, policy: DecodePolicy | None = None, prefix: bool = False, count_frames: bool = True, features: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of each blob. Without count_frames, frame_count is null where counting takes a walk through the blob."""
    return _apply(df, content, schema.INFO, "Inspection", _inspect(count_frames), fmt, policy, prefix, features)


def decode_images(df: DataFrame, content: str = "content", fmt: str | None = None, policy: DecodePolicy | None = None, prefix: bool = False, features: tuple[str, ...] | None = None) -> DataFrame:
    return _apply(df, content, schema.IMAGE, "StillDecode", _decode, fmt, policy, prefix, features)


def decode_frames(df: DataFrame, content: str = "content", fmt: str | None = None, policy: DecodePolicy | None = None, prefix: bool = False, frame_index: int | None = None, features: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each frame or page, or for the one of frame_index; a still image is one frame. In a prefix, missing
    bytes are NeedMoreData. To cancel or watch the job, run it inside functions.control.controlled."""
    return _apply(df, content, schema.FRAME, "SequenceDecode", _frames(frame_index), fmt, policy, prefix, features)


def check_lengths(decoded: DataFrame) -> DataFrame:
    """decode_images' rows with `length_ok`: whether the pixels have exactly the bytes that mode and size ask for."""
    wanted = catalog.transfer_bytes(F.col("value.mode"), F.col("value.width"), F.col("value.height"))
    return decoded.withColumn("length_ok", F.length("value.pixels") == wanted)


class LazyImages:
    """Blobs whose facts, pixels and frames are each computed once, when first asked for, and kept on the executors.

    Nothing is kept under a policy, so that a refusal is never remembered. release() lets go of all."""

    def __init__(self, df: DataFrame, content: str = "content"):
        self.df, self.content, self._kept = df, content, {}

    def _once(self, name: str, make: Callable, policy: DecodePolicy | None) -> DataFrame:
        if policy is not None:
            return make(self.df, self.content, policy=policy)
        if name not in self._kept:
            self._kept[name] = make(self.df, self.content).persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[name]

    def inspected(self, policy: DecodePolicy | None = None) -> DataFrame:
        return self._once("inspect", inspect_images, policy)

    def decoded(self, policy: DecodePolicy | None = None) -> DataFrame:
        return self._once("decode", decode_images, policy)

    def frames(self, policy: DecodePolicy | None = None) -> DataFrame:
        return self._once("frames", decode_frames, policy)

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept = {}


def verify_images(df: DataFrame, content: str = "content") -> DataFrame:
    return _apply(df, content, "string", "Verification", _verify, None, None, False)


def encode_images(df: DataFrame, fmt: str, image: str = "image", policy_max_bytes: int | None = None, **options) -> DataFrame:
    """df with ok, encoded (binary) and error instead of the image struct, of which width, height, mode, pixels,
    palette_rgb and palette_alpha count."""
    keep = [f for f in df.schema.fields if f.name != image]
    out = StructType(keep + StructType.fromDDL(f"ok boolean, encoded binary, error {schema.ERROR}").fields)
    names = [f.name for f in keep]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, blobs, errors = [], [], []
            for v in batch.column(batch.schema.get_field_index(image)).to_pylist():
                blob = error = None
                try:
                    if v is None:
                        raise CodecError("Parameter", "no image")
                    blob = codecs.encode(raster_of(v), fmt, **options)
                    if policy_max_bytes is not None and len(blob) > policy_max_bytes:
                        raise CodecError("LimitExceeded", "the output is too long", resource="EncodedOutputBytes", maximum=policy_max_bytes, observed=len(blob))
                except Exception as e:
                    blob, error = None, error_row(e, "StillEncode", fmt)
                good.append(error is None)
                blobs.append(blob)
                errors.append(error)
            own = [pa.array(x, f.type) for x, f in zip((good, blobs, errors), list(arrow)[len(names) :], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + own, schema=arrow)

    return df.mapInArrow(run, out)


def encode_sequences(frames: DataFrame, fmt: str, key: str | tuple[str, ...] = "image_id", policy_max_bytes: int | None = None, **options) -> DataFrame:
    """(key, ok, encoded, message) from rows (key, value: the frame struct of decode_frames), put in order of frame_index.

    The key is a column or several. A sequence longer than policy_max_bytes when encoded is refused."""
    keys = [key] if isinstance(key, str) else list(key)

    def run(group, table):
        rows = sorted(table.column("value").to_pylist(), key=lambda v: v["frame_index"])
        try:
            first = rows[0]
            parts = [Frame(raster_of(v["image"]), tuple(v["rect"][k] for k in ("left", "top", "width", "height")), (v["duration"]["num"], v["duration"]["den"]) if v["duration"] else None, v["disposal"] or 0) for v in rows]
            blob, message = codecs.encode_sequence(Sequence(first["canvas_width"], first["canvas_height"], parts, first["kind"], first["layout"], first["loop_count"]), fmt, **options), None
            if policy_max_bytes is not None and len(blob) > policy_max_bytes:
                raise CodecError("LimitExceeded", f"EncodedOutputBytes: {len(blob)} is over {policy_max_bytes}")
        except Exception as e:
            blob, message = None, str(e)
        return pa.table({**{k: pa.array([g.as_py()], table.column(k).type) for k, g in zip(keys, group, strict=True)}, "ok": [blob is not None], "encoded": pa.array([blob], pa.binary()), "message": pa.array([message], pa.string())})

    out = StructType([frames.schema[k] for k in keys] + StructType.fromDDL("ok boolean, encoded binary, message string").fields)
    return frames.select(*keys, "value").groupBy(*keys).applyInArrow(run, out)


def raster_column(samples: DataFrame, key: str = "image_id", strip_rows: int | None = None) -> DataFrame:
    """(key, image) of 8-bit gray rasters from exploded samples (key, y, x, v), rows first and then images.

    With strip_rows, (key, strip, image): an image for each strip of so many rows, for formats that limit the height."""
    two = F.lpad(F.hex("v"), 2, "0")
    keys = [key]
    if strip_rows:
        samples, keys = samples.withColumn("strip", F.floor(F.col("y") / strip_rows).cast("int")), [key, "strip"]
    rows = samples.groupBy(*keys, "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", two.alias("h")))), lambda p: p["h"]), "").alias("row"), F.count(F.lit(1)).alias("w"))
    images = rows.groupBy(*keys).agg(F.max("w").alias("width"), F.count(F.lit(1)).alias("height"), F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda r: r["row"]).alias("rows"))
    image = F.struct("width", "height", F.lit("L8").alias("mode"), F.unhex(F.array_join("rows", "")).alias("pixels"), F.lit(None).cast("binary").alias("palette_rgb"), F.lit(None).cast("binary").alias("palette_alpha"))
    return images.select(*keys, image.alias("image"))
