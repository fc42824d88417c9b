"""Operators on bytes hold little of their input and output at a time."""

import itertools
import tracemalloc
import zlib

import numpy as np

from rasterloom.operators import checksum, samples


def test_runs_leave_in_small_batches():
    rng = np.random.default_rng(5)
    blobs = [rng.integers(0, 3, 300_000, np.uint8).tobytes(), b"", b"a", b"a" * 200_000 + b"b", *[rng.integers(0, 9, 500, np.uint8).tobytes() for _ in range(4000)]]
    want = ((n, v, len(list(g))) for n, b in enumerate(blobs) for v, g in itertools.groupby(b))
    ends, batches = [0] * len(blobs), 0
    for batch in samples.runs_of(blobs):
        assert 0 < len(batch[0]) <= samples.RUN_ROWS + samples.RUN_BYTES
        batches += 1
        for n, start, value, length in zip(*(x.tolist() for x in batch), strict=True):
            assert (n, value, length) == next(want) and start == ends[n]
            ends[n] += length
    assert next(want, None) is None and ends == [len(b) for b in blobs] and batches > 20


def test_runs_need_no_memory_for_each_byte_of_input():
    blobs = [bytes(range(256)) * 4096] * 20  # 21 MB, a run for each byte
    tracemalloc.start()
    assert sum(len(x[0]) for x in samples.runs_of(blobs)) == 20 * 256 * 4096
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_runs_query_has_no_arrays_of_bytes(spark, tmp_path):
    from rasterloom.queries import QUERIES

    spark.createDataFrame([(1, "aab"), (2, ""), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["packbits_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 0, 97, 2), (1, 2, 98, 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan


def test_sums_need_no_memory_for_each_byte_of_input(spark, tmp_path):
    from rasterloom.queries import QUERIES

    blob = b"\xff\xfe" * 10_000_000
    tracemalloc.start()
    n, total, weighted = checksum.sums_of(blob)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6 and (n + weighted) % 65521 << 16 | (1 + total) % 65521 == zlib.adler32(blob)
    texts = ["ÿ" * 300_000, "a" * 65_536, "b" * 65_537, "", None, "c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["adler32_text"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(i, len(t.encode()), zlib.adler32(t.encode())) for i, t in enumerate(texts) if t]
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
