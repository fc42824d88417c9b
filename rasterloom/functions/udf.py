"""Codec functions for SQL and expressions: Arrow-batched, one struct a blob."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from rasterloom.functions import codecs
from rasterloom.functions.codecs.base import raster_bytes

_INSPECT = "format string, width bigint, height bigint, mode string, frame_count bigint, decoded_bytes bigint, error string"


@pandas_udf(_INSPECT)
def image_inspect(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            fmt, i = codecs.inspect(bytes(data) if data is not None else b"")
            rows.append((fmt, i.width, i.height, i.mode, i.frames, raster_bytes(i.mode, i.width, i.height), None))
        except Exception as e:  # any failure is this row's error
            rows.append((None, None, None, None, None, None, getattr(e, "kind", "Malformed")))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _INSPECT.split(", ")]).astype({c: "Int64" for c in ("width", "height", "frame_count", "decoded_bytes")})


@pandas_udf("binary")
def image_pixels(content: pd.Series) -> pd.Series:
    """Pixels of the still image, null where decoding fails."""

    def one(data: bytes | None) -> bytes | None:
        try:
            return codecs.decode(bytes(data))[1].value.pixels if data is not None else None
        except Exception:
            return None

    return content.map(one)


@pandas_udf("bigint")
def image_metadata_bytes(content: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> int | None:
        try:
            return codecs.metadata_bytes(bytes(data)) if data is not None else None
        except Exception:
            return None

    return content.map(one).astype("Int64")


def register(spark: SparkSession) -> None:
    for f in (image_inspect, image_pixels, image_metadata_bytes):
        spark.udf.register(f.__name__, f)
