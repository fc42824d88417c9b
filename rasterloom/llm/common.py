"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: A word is a run of characters other than the ASCII white space \x20 and \x09-\x0D; ``bytes.split()`` splits on
#: exactly that set. A worker remembers the hashes of so many words (about 10 MB).
WORD_CACHE = 60_000
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset, a temporary folder if the driver and the
    executors are one process (as in tests); on a cluster that is an error, as its machines share none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/spark-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.
    The shared folder's owner clears it, as with checkpoints."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a literal. createDataFrame copies rows through Python workers of their own on the executors,
    which stay there beside those that the operators use."""
    kind = StructType.fromDDL(schema)
    text = json.dumps([dict(zip(kind.names, row, strict=True)) for row in rows])  # one literal, however many rows
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), ArrayType(kind))))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key() -> F.Column:
    """64 bits of (doc_id, text): tells rows apart even where doc_id is null or repeated."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


class WordHash(dict):
    """word -> 64-bit hash, remembering at most WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE and len(word) < 64:
            self[word] = h
        return h


_words: WordHash | None = None


def word_hashes(words: list[bytes]) -> np.ndarray:
    global _words
    if _words is None:
        _words = WordHash()
    return np.fromiter(map(_words.__getitem__, words), dtype=U64, count=len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each output bit depends on every input bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=U64)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 3_000_000):
    """Parts of a batch with about `limit` bytes of text each (a longer single text stays whole)."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    start = 0
    while start < len(col):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(col))
        yield batch.slice(start, end - start), col.slice(start, end - start).to_pylist()
        start = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
