"""Decode and encode policies as ordered predicates: the first failure decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DecodePolicy:
    """Limits are inclusive; None is unlimited."""

    max_encoded_bytes: int | None = None
    formats: tuple[str, ...] | None = None
    max_metadata_bytes: int | None = None
    max_width: int | None = None
    max_height: int | None = None
    max_pixels: int | None = None
    max_primary_bytes: int | None = None
    max_frames: int | None = None
    max_frame_bytes: int | None = None
    max_sequence_bytes: int | None = None


FAILURE = "struct<kind:string,resource:string,maximum:bigint,observed:bigint>"


def _failure(kind: str, resource: str | None, maximum: int | None, observed: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(resource).cast("string").alias("resource"), F.lit(maximum).cast("bigint").alias("maximum"), observed.cast("bigint").alias("observed"))


def _limit(resource: str, maximum: int | None, observed: Column) -> Column:
    if maximum is None:
        return F.lit(None).cast(FAILURE)
    return F.when(observed > maximum, _failure("LimitExceeded", resource, maximum, observed)).cast(FAILURE)


def first_failure(policy: DecodePolicy, encoded: Column, fmt: Column, metadata: Column, width: Column, height: Column, primary: Column, frames: Column) -> Column:
    """struct<kind, resource, maximum, observed> of the first check that fails, null if none does.

    Order: encoded bytes, detection, allow-list, metadata bytes, width, height, pixels, primary bytes, frames.
    An unknown number of frames (null) passes."""
    none = F.lit(None).cast("bigint")
    allowed = F.lit(None).cast(FAILURE)
    if policy.formats is not None:
        inside = fmt.isin(*policy.formats) if policy.formats else F.lit(False)
        allowed = F.when(~inside, _failure("PolicyDenied", None, None, none)).cast(FAILURE)
    return F.coalesce(
        _limit("EncodedBytes", policy.max_encoded_bytes, encoded),
        F.when(fmt.isNull(), _failure("UnknownFormat", None, None, none)).cast(FAILURE),
        allowed,
        _limit("MetadataBytes", policy.max_metadata_bytes, metadata),
        _limit("Width", policy.max_width, width),
        _limit("Height", policy.max_height, height),
        _limit("Pixels", policy.max_pixels, width.cast("bigint") * height),
        _limit("PrimaryDecodedBytes", policy.max_primary_bytes, primary),
        _limit("FrameCount", policy.max_frames, frames),
    )


def output_failure(maximum: int | None, length: Column) -> Column:
    return _limit("EncodedOutputBytes", maximum, length)


def trailing_diagnostic(consumed: Column, length: Column) -> Column:
    """Place of the first byte after the container, null if there is none."""
    return F.when(consumed < length, consumed)
