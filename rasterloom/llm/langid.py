"""Language ID by hyperdimensional profiles.

A letter is a random +-1 vector of D dimensions. An n-gram binds its letters, each rotated by its place,
by elementwise product. A text bundles (adds) its n-gram vectors, a language prototype those of its
training texts, and a text gets the language whose prototype has the largest cosine with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import column, text_slices

DIMENSIONS, ORDER, SEED = 1024, 3, 20_111
#: The prototypes are broadcast: 8 KB each, so 16 MB for this many languages; more are refused.
MAX_LANGUAGES = 2_000
GRAM_CACHE, GRAM_BLOCK = 16_000, 4_096

_letters: dict[int, np.ndarray] = {}
_grams: dict[tuple, np.ndarray] = {}
_alpha: np.ndarray | None = None


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[code] = (2 * np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS) - 1).astype(np.int8)
    return _letters[code]


def gram_vector(codes: tuple) -> np.ndarray:
    v = _grams.get(codes)
    if v is None:
        v = np.ones(DIMENSIONS, np.int8)
        for place, c in enumerate(codes):
            v = v * np.roll(letter_vector(c), len(codes) - 1 - place)
        if len(_grams) >= GRAM_CACHE:
            _grams.clear()
        _grams[codes] = v
    return v


def _is_letter() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple], np.ndarray]:
    """Sparse counts of n-grams, by n-gram: (rank of the n-gram, text, count), the n-grams' code points, and
    whether each text has a letter.

    Text is lower-cased; a run of other characters than letters is one space, at both ends of a text too."""
    low = [" " + t.lower() + " " for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, np.uint32(32))
    doc = np.repeat(np.arange(len(low)), sizes)
    keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32) | (doc[1:] != doc[:-1])]
    codes, doc = codes[keep], doc[keep]
    has = np.zeros(len(low), bool)
    has[doc[codes != 32]] = True
    alphabet, x = np.unique(codes, return_inverse=True) if len(codes) < 1000 else _ranks(codes)
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), [], has
    gram = np.zeros(n, np.int64)
    for place in range(ORDER):
        gram = gram * len(alphabet) + x[place : place + n]
    whole = (doc[:n] == doc[ORDER - 1 :]) & has[doc[:n]]
    gram, doc = gram[whole], doc[:n][whole]
    space = len(alphabet) ** ORDER
    if space <= 4_000_000:
        present = np.flatnonzero(np.bincount(gram, minlength=space))
        rank = np.zeros(space, np.int64)
        rank[present] = np.arange(len(present))
        gram = rank[gram]
    else:
        present, gram = np.unique(gram, return_inverse=True)
    cell = gram * len(low) + doc
    if len(present) * len(low) <= 4_000_000:
        many = np.bincount(cell, minlength=len(present) * len(low))
        cell = np.flatnonzero(many)
        many = many[cell]
    else:
        cell, many = np.unique(cell, return_counts=True)
    digits = [alphabet[present // len(alphabet) ** (ORDER - 1 - place) % len(alphabet)] for place in range(ORDER)]
    return cell // len(low), cell % len(low), many.astype(np.float32), list(zip(*(d.tolist() for d in digits), strict=True)), has


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    present = np.zeros(int(codes.max()) + 1, bool)
    present[codes] = True
    return np.flatnonzero(present), (np.cumsum(present) - 1)[codes]


def bundles(texts: list[str], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each text's n-gram vectors (or, with weight (k x text), of k weighted sums of texts).

    Counts are made dense for GRAM_BLOCK n-grams at a time, so that a large alphabet takes time, not memory."""
    gram, doc, many, grams, has = gram_counts(texts)
    out = np.zeros((len(texts) if weight is None else len(weight), DIMENSIONS), np.float32)
    for i in range(0, len(grams), GRAM_BLOCK):
        part = grams[i : i + GRAM_BLOCK]
        lo, hi = np.searchsorted(gram, [i, i + GRAM_BLOCK])
        counts = np.zeros((len(texts), len(part)), np.float32)
        counts[doc[lo:hi], gram[lo:hi] - i] = many[lo:hi]
        if weight is not None:
            counts = weight.astype(np.float32) @ counts
        out += counts @ np.stack([gram_vector(g) for g in part]).astype(np.float32)
    return out, has


def held_out() -> F.Column:
    """Whether crc32 of the doc_id as text leaves 0 modulo 5 (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _parts(texts: list[bytes]) -> Iterator[slice]:
    """Slices of at most 256 texts: with GRAM_BLOCK they bound the matrix of counts at 4 MB."""
    for i in range(0, len(texts), 256):
        yield slice(i, i + 256)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, texts in text_slices(batch, "text", 3_000_000):
            langs = column(rows, "lang").to_pylist()
            for part in _parts(texts):
                names = sorted(set(langs[part]))
                weight = np.array([[x == n for x in langs[part]] for n in names], np.float32)
                for n, v in zip(names, bundles([t.decode() for t in texts[part]], weight)[0], strict=True):
                    sums[n] = sums[n] + v.astype(np.float64) if n in sums else v.astype(np.float64)
    names = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "v"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from docs(text, lang): each task adds up its texts by language, and Spark adds up the tasks'
    sums, at most one row for each task, language and dimension. Rows without lang or text teach nothing."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    sums = rows.mapInArrow(_learn, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang")
    found = sums.select("lang", F.transform("v", lambda v: v["x"]).alias("v")).limit(MAX_LANGUAGES + 1).toArrow()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    rows = found["v"].combine_chunks().flatten().to_numpy().reshape(len(found), -1) if len(found) else []
    return {lang: v for lang, v in zip(found["lang"].to_pylist(), rows, strict=True) if v.any()}


def _predict(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, proto = shared.value
        unit = proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-30) if len(names) else proto
        for batch in batches:
            for rows, texts in text_slices(batch, "text", 3_000_000):
                pred: list[str] = []
                score: list[float] = []
                for part in _parts(texts):
                    v, has = bundles([(t or b"").decode() for t in texts[part]])
                    if not len(names):
                        pred += ["und"] * len(v)
                        score += [0.0] * len(v)
                        continue
                    cos = v.astype(np.float64) @ unit.T / np.maximum(np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True), 1e-30)
                    best = np.argmax(np.round(cos, 9), axis=1)
                    pred += [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
                    score += np.where(has, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).tolist()
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), column(rows, "held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return run


def language_id(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Language of each whole text.

    In: docs(doc_id, text, any more), train(doc_id, text, lang; docs themselves if None), of which rows whose
    held_out() is false and whose lang isn't null are learnt from. Out: doc_id, held_out, lang_pred (`und`
    where text is null or has no letter, or nothing could be learnt), score (cosine, cut to 0..1). One row
    per input row. Ties go to the first language by name."""
    train = docs if train is None else train
    proto = learn(train.where(~held_out()).select("text", "lang"))
    names = sorted(proto)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.stack([proto[n] for n in names]) if names else np.zeros((0, DIMENSIONS))))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(shared), schema)
