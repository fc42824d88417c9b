"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens' lengths, then worker caches."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import column, text_slices

#: Bounds of the two tiers: entries, and bytes of one entry's key.
FREQUENT, CACHE, KEY_BYTES = 50_000, 500_000, 64
#: A task reports at most so many of its pre-tokens for the frequent table.
REPORTED = 3_000
#: Texts that a tokenizer must give the tokens of their words, or the method can't count with it: white space of
#: all kinds, single and repeated, at the ends, around punctuation, digits, capitals and other scripts.
PROBES = ("line one\nline two", " a", "a ", "a  b", "a \t\r\n\x0b\x0c b", "the cat.\n\nThe Dog, 12 345", "x = 1;\n    y = 2", "\n", " ", "日本 語\n日本", "é è\nÀ", "don't we'll\nI'm")


class Counts:
    """Numbers of tokens of pre-tokens: runs between white space, which the pre-tokenizer never joins."""

    def __init__(self, path: str):
        self.path, self.cache = path, {}
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
        else:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for t in PROBES:
            if self.lengths([t.encode()])[0] != sum(self.lengths(t.encode().split())):
                raise ValueError(f"this tokenizer does not split at white space: {t!r} has other tokens than its words")

    def lengths(self, words: list[bytes]) -> list[int]:
        if self.path.endswith(".json"):
            return [len(e) for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return [len(x) for x in self.sp.encode([w.decode() for w in words], num_threads=1)]

    def of(self, texts: list[list[bytes]], frequent: dict[bytes, int]) -> list[int]:
        cache, get, more = self.cache, frequent.get, self.cache.get
        found = [[get(w) or more(w) for w in words] for words in texts]
        # A length of 0 looks like a miss and is measured again; pre-tokens without tokens are rare.
        missing = {w for words, n in zip(texts, found, strict=True) if not all(n) for w, x in zip(words, n, strict=True) if not x}
        if missing:
            words = list(missing)
            new = dict(zip(words, self.lengths(words), strict=True))
            for words, n in zip(texts, found, strict=True):
                if not all(n):
                    n[:] = [new[w] if not x else x for w, x in zip(words, n, strict=True)]
            if len(cache) + len(new) > CACHE:
                cache.clear()
            cache.update((w, x) for w, x in new.items() if len(w) <= KEY_BYTES)
        return list(map(sum, found))


_counts: dict[str, Counts] = {}


def counts(path: str) -> Counts:
    if path not in _counts:
        _counts.clear()
        _counts[path] = Counts(path)
    return _counts[path]


def _report():
    """Space-saving in batches: a task keeps a bounded counter over all its texts and reports its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for t in texts:
                    if t:
                        top.update(t.split())
                if len(top) > 20 * REPORTED:
                    top = Counter(dict(top.most_common(4 * REPORTED)))
        best = [(w, n) for w, n in top.most_common(REPORTED) if n > 1 and len(w) <= KEY_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["w", "n"])

    return run


def frequent_lengths(docs: DataFrame, tokenizer: str, entries: int = FREQUENT) -> dict[bytes, int]:
    """At most `entries` frequent pre-tokens and their lengths. Only each task's bounded top list moves;
    the table decides speed alone, never a count, so its approximate ranks are harmless."""
    top = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_report(), "w binary, n bigint")
    best = top.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(entries).collect()
    words = [bytes(r["w"]) for r in best]
    return dict(zip(words, Counts(tokenizer).lengths(words), strict=True)) if words else {}


def _pack(table: dict[bytes, int]) -> tuple[bytes, bytes, bytes]:
    """Compact form: keys end to end, their sizes, the lengths."""
    keys = sorted(table)
    return b"".join(keys), np.array([len(k) for k in keys], np.uint8).tobytes(), np.array([table[k] for k in keys], np.uint32).tobytes()


def _unpack(packed: tuple[bytes, bytes, bytes]) -> dict[bytes, int]:
    keys, sizes, lengths = packed
    out, at = {}, 0
    for n, x in zip(sizes, np.frombuffer(lengths, np.uint32).tolist(), strict=True):
        out[keys[at : at + n]] = x
        at += n
    return out


_frequent: list = [None, {}]


def _count(tokenizer: str, shared):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts(tokenizer)
        if _frequent[0] != shared.value[:2]:
            _frequent[:] = [shared.value[:2], _unpack(shared.value)]
        for batch in batches:
            for rows, texts in text_slices(batch, "text", 3_000_000):
                n = table.of([t.split() if t else [] for t in texts], _frequent[1])
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Numbers of tokens of whole texts, as the library gives them without begin, end or added tokens.

    In: docs(doc_id, text, any more); tokenizer: path of a .json file whose pre-tokenizer splits at white
    space. Out: doc_id, n_bytes, n_tokens (long). One row per input row; a null text counts as empty. Two
    passes over the texts and no shuffle of pre-tokens: the first gathers the frequent table, at most
    FREQUENT keys of KEY_BYTES bytes (3.2 MB), which is broadcast; the second looks pre-tokens up in it,
    then in a cache of at most CACHE entries that the worker keeps, and encodes the rest. A tokenizer whose
    tokens depend on the white space around a word is refused with a ValueError, by its counts on PROBES."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_pack(frequent_lengths(docs, tokenizer)))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_count(tokenizer, shared), "doc_id bigint, n_bytes bigint, n_tokens bigint")
