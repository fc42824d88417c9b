"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of the model has a whitespace marker after another character, a merge never reaches
across the start of a marked word, so a text's ids are those of its marked words put together. Each
batch lists its distinct words, segments those that the worker's table lacks, once each, and joins the
ids back by position. Nothing is shuffled: the table is a bounded cache, and a word that has been
dropped from it is segmented again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import column, text_slices

MARK = "▁"
#: Bounds of a worker's table. Beyond them it keeps the words of the texts at hand.
TABLE_WORDS, TABLE_BYTES = 120_000, 48_000_000
_SCHEMA = "doc_id bigint, ids array<int>, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def crossing_pieces(sp) -> list[str]:
    """Pieces that rule the method out: with a marker after another character."""
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()) if not sp.is_control(i) and not sp.is_unknown(i))
    return [p for p in pieces if MARK in p.lstrip(MARK)]


class Chunks:
    """Distinct marked words of a model: ids and decoded text of each, segmented once."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if crossing := crossing_pieces(self.sp):
            raise ValueError(f"pieces of this model cross whitespace markers, such as {crossing[0]!r}")
        self.letter = self.sp.encode("a")
        if self.sp.id_to_piece(self.sp.encode("\n")[0]) != MARK or self.sp.decode(self.letter) != "a":
            raise ValueError("this model adds no marker before a text; marked words can't be segmented by themselves")
        self.lead = self.sp.encode("\n")[0]
        self.splits_lines = not any("\n" in self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not self.sp.is_byte(i))
        self.word = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+" if self.splits_lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.plain = np.array([not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(self.sp.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.text: list[str] = []
        self.bytes = 0
        self.flat = None

    def shrink(self, words: set[str]) -> None:
        """Forget all words but these: those in the texts at hand, which the most frequent ones are among."""
        kept = [(w, self.ids[i], self.text[i]) for w in sorted(words) for i in (self.index[w],)]
        self.clear()
        for w, x, t in kept:
            self.put(w, x, t)

    def put(self, word: str, ids: list[int], text: str) -> None:
        self.index[word] = len(self.ids)
        self.ids.append(ids)
        self.text.append(text)
        # Two strings, a list and its integers with their headers, and their places in the table.
        self.bytes += 330 + 4 * len(word) + 12 * len(ids)

    def split(self, text: str) -> list[str]:
        """Marked words: a run of markers with what follows up to the next marker, cut before newlines too,
        which no piece holds. The marker that the library puts before a text is written out."""
        return self.word.findall(self.sp.normalize(text))

    def add(self, words: list[str]) -> None:
        # The library puts a marker before what it encodes: it stands for the word's own first marker,
        # or, for words without one, it is a piece by itself as nothing merges over a newline.
        ids = self.sp.encode([w[1:] if w[0] == MARK else w for w in words], num_threads=1)
        # An empty text gets no marker, so the lone marker is given its id here.
        ids = [([self.lead] if w == MARK else x) if w[0] == MARK else x[1:] for w, x in zip(words, ids, strict=True)]
        # A word's plain pieces spell it out, markers standing for spaces; decode() handles all others.
        # It drops the marker at the start of a text, so such words are decoded after a letter.
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        odd = np.zeros(len(ids), bool)
        odd[np.repeat(np.arange(len(ids)), sizes)[~self.plain[np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))]]] = True
        texts = [w.replace(MARK, " ") for w in words]
        at = np.flatnonzero(odd).tolist()
        for i, t in zip(at, self.sp.decode([self.letter + ids[i] for i in at], num_threads=1), strict=True):
            texts[i] = t[1:]
        for w, x, t in zip(words, ids, texts, strict=True):
            self.put(w, x, t)
        self.flat = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.flat is None:
            sizes = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
            self.flat = (np.fromiter(chain.from_iterable(self.ids), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes)
        return self.flat

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids, each text's number of ids, and the decoded texts."""
        split = [self.split(t) for t in texts]
        fresh = set(chain.from_iterable(split)) - self.index.keys()
        if len(self.index) + len(fresh) > TABLE_WORDS or self.bytes > TABLE_BYTES:
            self.shrink(set(chain.from_iterable(split)) - fresh)
        if fresh:
            self.add(sorted(fresh))
        flat, begin, sizes = self.tables()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[at] - (ends - n), n) + np.arange(int(n.sum()))]
        per = np.r_[0, ends][np.cumsum(counts)] - np.r_[0, ends][np.cumsum(counts) - counts]
        decoded, i, text = [], 0, self.text
        for c in counts.tolist():
            s = "".join([text[x] for x in at[i : i + c].tolist()])
            decoded.append(s[1:] if s.startswith(" ") else s)  # as decode() does with the first piece's marker
            i += c
        return ids, per, decoded


_tables: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    if path not in _tables:
        _tables.clear()
        _tables[path] = Chunks(path)
    return _tables[path]


def _encode(path: str, add_eos: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(path)
        end = [table.sp.eos_id()] if add_eos else []
        for batch in batches:
            for rows, texts in text_slices(batch, "text", 2_000_000):
                ids, per, decoded = table.encode([(t or b"").decode() for t in texts])
                ids = np.insert(ids, np.cumsum(per), end[0]) if end else ids
                offsets = np.r_[0, np.cumsum(per + len(end))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())], schema=_ARROW)

    return run


def sentencepiece_roundtrip(docs: DataFrame, model: str, add_eos: bool = True) -> DataFrame:
    """Ids of each whole text as the library's encode() gives them, and what its decode() makes of them.

    In: docs(doc_id, text, any more); model: path of a .model file that all executors can open. Out:
    doc_id, ids (array<int>, with the end id if add_eos), decoded (string). One row per input row; a null
    text counts as empty. Raises where the model's pieces cross markers, as the method needs that."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_encode(model, add_eos), _SCHEMA)
