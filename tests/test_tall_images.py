"""Images of more rows than a WebP may have: they grow with the table."""

import hashlib

import numpy as np
import pytest

from rasterloom.plans import image_queries
from rasterloom.queries import QUERIES


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """One image of 17,000 rows, one of 3; constant in part, two samples a row."""
    d = str(tmp_path_factory.mktemp("tall"))
    rows = [(i, [((i // 50 * 7) % 256 - 127.5) / 128, ((i * 13) % 256 - 127.5) / 128], int(i % 5000 == 4999)) for i in range(17_003)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4).write.parquet(f"{d}/embeddings.parquet")
    level = lambda e: np.clip(np.floor((np.float32(e).astype(np.float64) + 1) * 127.5), 0, 255).astype(np.uint8)
    return d, {k: level([e for _, e, n in rows if n == k]) for k in (0, 1)}


def test_webp_round_trip(spark, tall):
    d, images = tall
    want = [(k, 2, len(a), hashlib.sha256(a.tobytes()).hexdigest()) for k, a in images.items()]
    assert want[0][2] > 16_384
    assert sorted(map(tuple, QUERIES["roundtrip_webp"](spark, d).collect())) == want


def test_webp_round_trip_of_strips_in_order(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, QUERIES["roundtrip_webp"](spark, sf_dir).collect()))
    monkeypatch.setattr(image_queries, "STRIP", 3)
    assert sorted(map(tuple, QUERIES["roundtrip_webp"](spark, sf_dir).collect())) == whole


def test_sequence_frames(spark, tall):
    want = [(k, i, i + 1, "Canvas") for k in (0, 1) for i in range(3)]
    assert sorted(map(tuple, QUERIES["sequence_frames"](spark, tall[0]).collect())) == want
