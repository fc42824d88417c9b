"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import U64, column, mix64, parallelism, powers, row_key, text_slices, word_hashes

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text whose windows one range of hash values holds on average: about 11 million, sorted in 350 MB.
RANGE_BYTES = 64_000_000
KNOWN = 0xFFFFFFFF  # the place of a window that its own block already knows to be repeated

_pow: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]


def window_hashes(v: np.ndarray, width: int) -> np.ndarray:
    """Rolling polynomial hash modulo 2**64 of each `width` consecutive values, from one running sum.

    With S(i) = sum of v[j] * B**j for j < i, the window at i hashes to (S(i + width) - S(i)) * B**-i."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    if len(_pow[0]) < len(v):
        _pow[0], _pow[1] = powers(BASE, 2 * len(v)), powers(INVERSE, 2 * len(v))
    s = np.zeros(len(v) + 1, U64)
    np.cumsum(v * _pow[0][: len(v)], out=s[1:])
    return mix64((s[width:] - s[:-width]) * _pow[1][:n])


def _planes(a: np.ndarray) -> bytes:
    """Byte planes: the high bytes of sorted hashes and of places are nearly constant and compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    d = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(d.itemsize, -1).T).view(d).ravel()


_BLOCK = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary())])
_FOUND = pa.schema([("slice", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])
_SPANS = pa.schema([("k", pa.int64()), ("spans", pa.list_(pa.int32()))])


def _listed(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Keys and sizes of the documents that have one of the places, and the places counted along those alone."""
    begin = np.cumsum(sizes) - sizes
    doc = np.searchsorted(begin, places, "right") - 1
    used = np.unique(doc)
    moved = np.cumsum(sizes[used]) - sizes[used]
    at = places - begin[doc] + moved[np.searchsorted(used, doc)]
    return keys[used].tobytes(), _planes(sizes[used].astype(np.uint32)), at.astype(np.uint32)


def _steps(places: np.ndarray) -> bytes:
    """Sorted places by their differences, which are small."""
    return _planes(np.diff(places, prepend=np.uint32(0)))


def _unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, np.uint32), dtype=np.int64)


def _blocks(width: int, parts: int):
    """Per slice of documents: the distinct window hashes, dealt to `parts` ranges of hash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text", 8_000_000):
                split = [t.split() if t else [] for t in texts]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                keep = np.flatnonzero(sizes >= width)
                if not len(keep):
                    continue
                keys = column(rows, "k").to_numpy(zero_copy_only=False)[keep]
                sizes = sizes[keep]
                v = word_hashes([w for i in keep for w in split[i]])
                del split
                h = window_hashes(v, width)
                end = np.cumsum(sizes)
                whole = np.ones(len(h), bool)  # windows within one document
                for e in end[:-1]:
                    whole[max(0, e - width + 1) : e] = False
                at = np.flatnonzero(whole).astype(np.uint32)
                h = h[at]
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                same = h[1:] == h[:-1]
                first = np.r_[True, ~same]
                many = np.r_[False, same] | np.r_[same, False]
                known = at[many]
                at = np.where(many, np.uint32(KNOWN), at)[first]
                h = h[first]
                part = ((h >> U64(32)) * U64(parts)) >> U64(32)
                cuts = np.searchsorted(part, np.arange(parts + 1, dtype=U64))
                name = xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63)
                out: list[list] = [[] for _ in _BLOCK]
                for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
                    hs, ps = h[cuts[p] : cuts[p + 1]], at[cuts[p] : cuts[p + 1]].copy()
                    own = ps != KNOWN
                    listed, its_sizes, ps[own] = _listed(keys, sizes, ps[own].astype(np.int64))
                    for o, x in zip(out, (int(p), name, listed, its_sizes, _planes(hs), _planes(ps)), strict=True):
                        o.append(x)
                if len(known):  # repeated within the slice: goes on to its documents as it is
                    listed, its_sizes, ps = _listed(keys, sizes, np.sort(known).astype(np.int64))
                    for o, x in zip(out, (name % parts, name, listed, its_sizes, None, _steps(ps)), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, _BLOCK, strict=True)], schema=_BLOCK)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of hash values: for each slice, the places of its windows whose hash occurs more than once."""
    tables, hashes, places, owner = [], [], [], []
    for batch in batches:
        passed: list[list] = [[], [], [], []]
        for row in zip(*(column(batch, c).to_pylist() for c in ("slice", "keys", "sizes", "places", "hashes")), strict=True):
            if row[4] is None:
                for o, x in zip(passed, row, strict=False):
                    o.append(x)
                continue
            tables.append(row[:3])
            hashes.append(_unplanes(row[4], U64))
            places.append(_unplanes(row[3], np.uint32))
            owner.append(len(places[-1]))
        if passed[0]:
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(passed, _FOUND, strict=True)], schema=_FOUND)
    if not hashes:
        return
    h, at = np.concatenate(hashes), np.concatenate(places)
    own = np.repeat(np.arange(len(owner), dtype=np.int32), owner)
    del hashes, places
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    many = order[np.r_[False, same] | np.r_[same, False]]
    many = np.sort(many[at[many] != KNOWN])
    cuts = np.searchsorted(own[many], np.arange(len(tables) + 1))
    out: list[list] = [[], [], [], []]
    for i, (name, keys, sizes) in enumerate(tables):
        if cuts[i + 1] > cuts[i]:
            found = np.sort(at[many[cuts[i] : cuts[i + 1]]]).astype(np.int64)
            listed, its_sizes, ps = _listed(np.frombuffer(keys, np.int64), _unplanes(sizes, np.uint32).astype(np.int64), found)
            for o, x in zip(out, (name, listed, its_sizes, _steps(ps)), strict=True):
                o.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, _FOUND, strict=True)], schema=_FOUND)


def _merged(width: int):
    """Sorted by slice: a row for each document, with the maximal intervals that its repeated windows cover."""

    def spans(keys: list[np.ndarray], starts: list[np.ndarray]) -> pa.RecordBatch:
        k, s = np.concatenate(keys), np.concatenate(starts)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] > s[:-1] + width)]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(k) - 1]
        pairs = np.stack([s[new], s[last] + width], axis=1).astype(np.int32)
        k = k[new]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        offsets = np.r_[2 * first, 2 * len(k)].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs.ravel()))], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, starts = None, [], []
        for batch in batches:
            for name, k, n, p in zip(*(column(batch, c).to_pylist() for c in ("slice", "keys", "sizes", "places")), strict=True):
                if name != at and keys:
                    yield spans(keys, starts)
                    keys, starts = [], []
                at = name
                sizes, places = _unplanes(n, np.uint32).astype(np.int64), _unsteps(p)
                begin = np.cumsum(sizes) - sizes
                doc = np.searchsorted(begin, places, "right") - 1
                keys.append(np.frombuffer(k, np.int64)[doc])
                starts.append(places - begin[doc])
        if keys:
            yield spans(keys, starts)

    return run


def repeated_spans(docs: DataFrame, width: int = 35) -> DataFrame:
    """(k, spans): for each row key of docs(k, text), flat [from, to) pairs of words that repeated windows cover.

    Hash values are cut into as many equal ranges as there are shuffle partitions, or as RANGE_BYTES of text for
    each ask for, so that what one task sorts is bounded. A slice of
    documents sends each of its distinct hashes once, as packed 8-byte values with 4-byte places, so a
    passage that a third of the corpus shares adds one value for each slice, not for each document. What is
    repeated goes back to the slices, a row for each slice and range, and is merged there."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(parallelism(docs.sparkSession), -(-total // RANGE_BYTES))
    packed = docs.select("k", F.col("text").cast("binary").alias("text")).mapInArrow(_blocks(width, parts), "part int, slice bigint, keys binary, sizes binary, hashes binary, places binary")
    found = packed.repartitionById(parts, F.col("part")).mapInArrow(_repeated, "slice bigint, keys binary, sizes binary, places binary")
    return found.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_merged(width), "k bigint, spans array<int>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("intervals", pa.list_(pa.list_(pa.int32())))])
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            out: list[list] = [[], [], [], []]
            for text, flat in zip(texts, column(rows, "spans").to_pylist(), strict=True):
                words = text.split() if text else []
                n, spans = len(words), []
                if flat:
                    spans = [flat[i : i + 2] for i in range(0, len(flat), 2)]
                    kept, at = [], 0
                    for a, b in spans:
                        kept += words[at:a]
                        at = b
                    words = kept + words[at:]
                for o, x in zip(out, (n, n - len(words), b" ".join(words), spans), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), *(pa.array(o, f.type) for o, f in zip(out, list(schema)[1:], strict=True))], schema=schema)


def substring_dedup(docs: DataFrame, width: int = 35) -> DataFrame:
    """Remove each word covered by a window of `width` words whose word sequence starts anywhere else too.

    In: docs(doc_id, text, any more). Out: doc_id, n_words, n_removed, kept (string: kept words joined
    by a space), intervals (array of maximal [from, to) word intervals removed). One row per input row.
    Null and empty texts have no words. Rows repeated whole are each other's copies and lose all
    windows; null doc_ids stay rows of their own. Words are compared as bytes. Sequences are told
    apart by 64-bit polynomial hashes over 64-bit word hashes."""
    docs = docs.select("doc_id", "text").withColumn("k", row_key())
    spans = repeated_spans(docs, width).dropDuplicates(["k"])  # rows repeated whole have one key and equal spans
    joined = docs.join(spans, "k", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return joined.mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept binary, intervals array<array<int>>").withColumn("kept", F.col("kept").cast("string"))
