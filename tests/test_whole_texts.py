"""Checksums and runs of whole texts, by brute force."""

import itertools
import zlib

from rasterloom.queries import QUERIES


def test_checksums_and_runs_read_whole_texts(spark, tmp_path):
    texts = ["a" * 300 + "é" * 200 + "b", "x" * 256 + "y" * 9, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [t.encode() for t in texts]
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert run("crc32_text") == [(i, zlib.crc32(b)) for i, b in enumerate(raw)]
    assert run("adler32_text") == [(i, len(b), zlib.adler32(b)) for i, b in enumerate(raw)]
    want = []
    for i, b in enumerate(raw):
        at = 0
        for v, g in itertools.groupby(b):
            n = len(list(g))
            want.append((i, at, v, n))
            at += n
    assert run("packbits_runs") == sorted(want)
