"""MinHash near-dedup by a join over inverted signature coordinates.

A text's class is its set of word shingles; texts with equal sets are one class. A class's signature has
COORDS coordinates, each posted under (coordinate, value). Two sets of similarity s agree in a coordinate
with probability s, so a linked pair agrees in at least MATCHES of them but for a chance below 1e-6 (at the
limit of 0.8 itself; far less above). Any pair that agrees in MATCHES coordinates shares one of the
PREFIX rarest postings of both (prefix filter, with coordinates ordered by how many classes have them), so
only these are joined; the remaining coordinates are counted by lookup in the signatures (skip merging).
Pairs above the threshold are confirmed on full sets.

Long lists, as groups of near copies make, take two steps. First each member is compared with the list's most
central class alone, which is linear and joins most groups of copies. Then the members of lists with one
centre are one group, and only groups whose members still lie in several components are searched for links
across these, in blocks bounded by bytes, by a second, longer signature and then on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import U64, column, materialize, mix64, row_key, text_slices, word_hashes
from rasterloom.llm.components import components

COORDS, MATCHES, SEED = 48, 24, 7
PREFIX = COORDS - MATCHES + 1
#: The second signature has LONG coordinates of one byte. A pair of similarity 0.8 agrees in fewer than LONG_MATCHES
#: with a chance of 1e-11; one of 0.5 agrees in as many with a chance of 5e-5.
LONG, LONG_MATCHES = 256, 160
#: The broadcast table of frequent postings has at most this many 16-byte entries, by its threshold.
FREQUENT_POSTINGS = 200_000
#: Posting lists up to SHORT classes give pairs; longer ones are compared with a centre, in parts of STAR members.
SHORT, STAR = 8, 1_000
#: What one side of a comparison across components holds: bytes of text, and members.
BLOCK_BYTES, BLOCK = 4_000_000, 1_000
#: Rows of a posting's list that one task joins; longer lists are salted.
SALTED = 4_096

_B = [U64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)]
_SALTS = mix64(np.arange(1, COORDS + LONG + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(SEED))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased; the whole sequence if shorter."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, U64)
    v = word_hashes(words)
    n = min(size, len(v))
    h = np.full(len(v) - n + 1, n, U64)
    for j in range(n):
        h = mix64(h + v[j : j + len(h)]) * _B[j % 4]
    return np.unique(h)


def _least(s: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The least salted hash of a set for each salt."""
    least = np.full(len(salts), np.iinfo(np.uint64).max, U64)
    for i in range(0, len(s), 2048):  # bounds the table of hashes for very long texts
        x = s[None, i : i + 2048] ^ salts[:, None]
        x = (x ^ (x >> U64(31))) * _B[0]
        np.minimum(least, (x ^ (x >> U64(29))).min(axis=1), out=least)
    return mix64(least)


def signature(s: np.ndarray) -> np.ndarray:
    """COORDS numbers: a coordinate's number above 32 bits of its least salted hash."""
    return (np.arange(COORDS, dtype=U64) << U64(32) | (_least(s, _SALTS[:COORDS]) >> U64(32))).view(np.int64)


def long_signature(s: np.ndarray) -> np.ndarray:
    return (_least(s, _SALTS[COORDS:]) >> U64(56)).astype(np.uint8)


def _classes(size: int):
    schema = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("bytes", pa.int64()), ("c", pa.int64()), ("sig", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                n, c, sig = [], [], []
                for t in texts:
                    s = shingles(t, size)
                    n.append(len(s))
                    c.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                    sig.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([column(rows, "k"), column(rows, "doc_id"), pa.array(n, pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(c, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], schema=schema)

    return run


def _prefixes(shared):
    """The PREFIX rarest postings of each class, and how central the class is: its postings' frequencies.

    A posting's rows are dealt to `salts` parts, by its frequency, so that a very long list is no hot key."""
    schema = pa.schema([("t", pa.int64()), ("salts", pa.int32()), ("salt", pa.int32()), ("c", pa.int64()), ("central", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            sig = column(batch, "sig")
            t = sig.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), COORDS)
            n = np.zeros(t.shape, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                n = np.where(known[at] == t, often[at], 0)
            order = np.lexsort((t, n), axis=1)[:, :PREFIX]
            c = column(batch, "c").to_numpy(zero_copy_only=False)
            # Ties in centrality fall to the class number, in the low bits.
            central = ((np.log2(n + 1.0).sum(axis=1) * 16).astype(np.int64) << 40) | (c.view(U64) >> U64(24)).view(np.int64)
            salts = (np.take_along_axis(n, order, 1).ravel() // SALTED + 1).astype(np.int32)
            rows = np.repeat(c, PREFIX)
            salt = (mix64(rows.view(U64)) % salts.astype(U64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.take_along_axis(t, order, 1).ravel(), salts, salt, rows, np.repeat(central, PREFIX))], schema=schema)

    return run


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of a sorted set each of several sorted sets has."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    ends = np.cumsum([len(x) for x in others])
    total = np.r_[0, np.cumsum(one[at] == flat)]
    return total[ends] - total[np.r_[0, ends[:-1]]]


def _links(sets: list[np.ndarray], names: list[int], cut: int, labels: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join different labels among sets, of which the first `cut` are compared with the others (with
    each other where cut is their number). What a link has joined is one label from then on."""
    size = np.array([len(x) for x in sets])
    sigs = np.stack([long_signature(x) for x in sets])
    label = np.unique(np.array(labels), return_inverse=True)[1]
    cols = np.arange(len(sets)) if cut == len(sets) else np.arange(cut, len(sets))
    theirs = np.ascontiguousarray(sigs[cols].T)
    for lo in range(0, cut, 256):
        rows = np.arange(lo, min(lo + 256, cut))
        ask = label[rows][:, None] != label[cols][None, :]
        if not ask.any():
            continue
        equal = np.zeros(ask.shape, np.uint16)
        for x, y in zip(sigs[rows].T, theirs, strict=True):
            equal += x[:, None] == y[None, :]
        ask &= equal >= LONG_MATCHES
        for i in rows[ask.any(axis=1)].tolist():
            near = cols[ask[i - lo] & (label[cols] != label[i])]
            if not len(near):
                continue
            both = _shared(sets[i], [sets[j] for j in near])
            for j in near[100 * both >= percent * (size[i] + size[near] - both)].tolist():
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    yield names[i], names[j]


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=_LINK)


def _stars(size: int, percent: int):
    """Sorted by (p, parts, part), the centre's text first: members linked to the centre, one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            found = []
            for p, c, text in zip(*(column(batch, x).to_pylist() for x in ("p", "c", "text")), strict=True):
                if c is None:
                    if p != at:
                        at, centre = p, shingles(text, size)
                elif p == at and _near(centre, shingles(text, size), percent):
                    found.append((p, c))
            yield _batch(found)

    return run


def _across(size: int, percent: int):
    """Sorted by (p, i, j): one pair of blocks of a group at a time; links across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []

        def done() -> list[tuple[int, int]]:
            if at is None or len({x[2] for x in members}) < 2:
                return []
            members.sort(key=lambda x: x[0])
            cut = len(members) if at[1] == at[2] else sum(not x[0] for x in members)
            return list(_links([x[3] for x in members], [x[1] for x in members], cut, [x[2] for x in members], percent))

        for batch in batches:
            found = []
            for *key, side, c, root, text in zip(*(column(batch, x).to_pylist() for x in ("p", "i", "j", "side", "c", "root", "text")), strict=True):
                if key != at:
                    found += done()
                    at, members = key, []
                members.append((side, c, root, shingles(text, size)))
            yield _batch(found)
        yield _batch(done())

    return run


def _texts(rows: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(c, text) of the classes that rows(c) name, by one of each class's documents."""
    need = rows.select("c").distinct().join(reps.select("c", "k"), "c")
    return docs.join(need, "k").select("c", F.col("text").cast("binary").alias("text")).dropDuplicates(["c"])


def _matching(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows of pairs(p, c, parts) that agree in MATCHES coordinates, counted by lookup in the signatures.

    A centre's signature is looked up for each part of its members, so that it is no hot key."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("c"), "parts"))
    heads = pairs.select("p", "parts").distinct().join(sigs.select(F.col("c").alias("p"), F.col("sig").alias("s2")), "p")
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)))
    both = pairs.join(sigs.select("c", F.col("sig").alias("s1")), "c").join(heads, ["p", "parts", "part"])
    return both.where(F.size(F.array_intersect("s1", "s2")) >= MATCHES).select("p", "c", "parts", "part")


def _star_links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): which of pairs(p, c, parts, part) are linked. A part of a centre's members comes with the centre's text."""
    texts = _texts(pairs.select("c").unionByName(pairs.select(F.col("p").alias("c"))), docs, reps)
    heads = pairs.select("p", "parts", "part").distinct().join(texts.withColumnRenamed("c", "p"), "p").select("p", "parts", "part", F.lit(None).cast("bigint").alias("c"), "text")
    rows = heads.unionByName(pairs.join(texts, "c").select("p", "parts", "part", "c", "text"))
    rows = rows.repartition("p", "parts", "part").sortWithinPartitions("p", "parts", "part", F.col("c").asc_nulls_first())
    return rows.mapInArrow(_stars(size, percent), "u bigint, v bigint")


def _cross_links(groups: DataFrame, roots: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(u, v): links across the components roots(node, root), within groups(p, c). None if no group has several."""
    rows = groups.join(reps.select("c", "bytes"), "c").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    several = rows.groupBy("p").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("bytes").alias("sum"), F.count(F.lit(1)).alias("n")).where("a <> b")
    blocks = F.ceil(F.greatest(F.col("sum") / BLOCK_BYTES, F.col("n") / BLOCK)).cast("int")
    rows = materialize(rows.join(several.select("p", blocks.alias("blocks")), "p").select("p", "c", "root", "blocks"))
    if rows.isEmpty():
        return None
    # Each member goes to the pairs of its own block with every other one.
    rows = rows.withColumn("b", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("p", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).alias("side"), "c", "root")
    rows = rows.join(_texts(rows, docs, reps), "c").repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    return rows.mapInArrow(_across(size, percent), "u bigint, v bigint")


def class_roots(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root): the least class that chains of linked pairs reach, for each class that they reach from above.

    Any two linked classes meet in a posting list. The pairs of a short list (SHORT members, so a bounded number
    for each posting), and those of a long list's members with its most central one, are counted by signature
    and confirmed if above the threshold. Then long lists are searched across the components found, and what
    is found there joins components as a whole."""
    spark = docs.sparkSession
    reps = materialize(classes.groupBy("c").agg(F.min("k").alias("k")).join(classes.select("c", "k", "sig", "bytes").dropDuplicates(["c", "k"]), ["c", "k"]))
    total = reps.count()
    limit = max(32, -(-COORDS * total // FREQUENT_POSTINGS))  # at most COORDS * total / limit postings reach it
    often = reps.select(F.explode("sig").alias("t")).groupBy("t").count().where(F.col("count") >= limit).orderBy("t").toPandas()
    shared = spark.sparkContext.broadcast((often["t"].to_numpy(np.int64), often["count"].to_numpy(np.int64)))
    sigs = reps.select("c", "sig")
    lists = sigs.mapInArrow(_prefixes(shared), "t bigint, salts int, salt int, c bigint, central bigint")
    heads = lists.groupBy("t").agg(F.max_by("c", "central").alias("p"), F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts")).where("n > 1")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    lists = materialize(lists.select("t", "salt", "c").join(heads, ["t", "salt"]).select("t", "c", "p", "n"))
    short = lists.where(f"n <= {SHORT}").select("t", "c")
    pairs = short.join(short.select("t", F.col("c").alias("p")), "t").where("p < c").select("p", "c", F.lit(1).alias("n"))
    long = lists.where(f"n > {SHORT}")
    pairs = pairs.unionByName(long.where("c <> p").select("p", "c", "n")).groupBy("p", "c").agg(F.ceil(F.max("n") / STAR).cast("int").alias("parts"))
    roots = components(_star_links(materialize(_matching(pairs, sigs)), docs, reps, size, percent))
    more = _cross_links(long.select("p", "c").distinct(), roots, docs, reps, size, percent)
    if more is None:
        return roots
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    more = materialize(more).join(of("u"), "u", "left").join(of("v"), "v", "left")
    top = components(more.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
    # A node of the first components is never the least of one, so the two have no node in common.
    lifted = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return lifted.select("node", F.coalesce("top", "root").alias("root")).unionByName(top)


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, key: bool = False) -> DataFrame:
    """Classes of near duplicates.

    In: docs(doc_id, text, any more). Out: doc_id, n_shingles, component_id, kept. One row per input row.
    Documents are linked where 100 * shared >= percent * united of their distinct `size`-word shingles (words
    between ASCII white space, A-Z lower-cased; a shorter text is one shingle). component_id is the least
    doc_id that links reach; kept is doc_id = component_id. Null texts and texts without words have no
    shingle and are linked with nothing. A null doc_id gets the least id of its class; where all of a class are
    null, so is the component, and they are kept. With `key` the row key k, xxhash64 of doc_id and text, comes too."""
    docs = docs.select("doc_id", "text").withColumn("k", row_key())
    classes = materialize(docs.select("k", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_classes(size), "k bigint, doc_id bigint, n_shingles bigint, bytes bigint, c bigint, sig array<bigint>"))
    roots = class_roots(docs.select("k", "text"), classes.where("c IS NOT NULL").select("k", "c", "sig", "bytes"), size, percent)
    least = classes.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    least = least.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(whole, "root").select("c", "component_id")
    out = classes.select("k", "doc_id", "n_shingles", "c").join(named, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["k"] if key else []))
