"""Quality rules with cross-document line frequency, in SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialize

#: A normalised line is boilerplate in a host where it is in more than LINE_FLOOR distinct documents and in more
#: than LINE_SHARE of the host's. However large the host, more than LINE_MOST distinct documents suffice.
LINE_FLOOR, LINE_SHARE, LINE_MOST = 5, 0.02, 200
#: Copies count as one distinct document: a document is known by the least md5 of its 3-word windows, which near
#: copies share as often as they share windows. To save digests, windows that begin with a word of SKETCH_LETTERS
#: code points or more stand for all, unless fewer than one word in SKETCH_FEW is that long.
SKETCH_LETTERS, SKETCH_FEW = 7, 8
#: A document is depleted if, without such lines, fewer than this share of its words is left.
LEFT_SHARE = 0.2
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: The set of frequent lines is broadcast up to this many 8-byte hashes (by its counted size), else joined by shuffle.
BROADCAST_LINES = 500_000


SPACES, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"


def _without(text: Column, chars: str, mark: str = "") -> Column:
    """text with each of a few characters replaced; a pass over bytes for each, which finds most of them nowhere."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(mark))
    return text


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space. A split at one plain character needs no regular expression."""
    return F.array_remove(F.split(_without(text, SPACES[:-1], " "), " ", -1), "")


def normalised(w: Column) -> Column:
    """A line from its words: lower case, white space runs as one space, none at the ends, digits as 0."""
    return F.regexp_replace(F.lower(F.array_join(w, " ")), "[0-9]+", "0")


def _next(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def _window(w: Column, i: Column) -> tuple[Column, Column]:
    """The two words after place i."""
    return F.get(w, i + 1), F.get(w, i + 2)


def repeat_words(rows: DataFrame, w: str, out: str) -> DataFrame:
    """rows with `out`: words that lie in a 3-word window found twice or more in the array of words `w`.

    A text whose windows' hashes are all distinct has none. In others the hashes are sorted with their places;
    equal neighbours mark places, which are sorted again, and each marked window adds the words up to the next
    one, three at most. All steps are array functions on whole arrays, n log n for a text of n words; each step
    is a column of its own, so it is computed once."""
    own = [f"`{c}`" for c in rows.columns]
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *_window(F.col(w), i)))
    rows = rows.select(*own, F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0))).alias("__g"))
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    rows = rows.select(*own, F.when(some, F.col("__g")).otherwise(F.array().cast("array<bigint>")).alias("__g"))
    rows = rows.select(*own, F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))).alias("__s"))
    # Of each sorted window: its place if the next one is equal, and the next one's.
    marks = F.zip_with("__s", _next(F.col("__s")), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    rows = rows.select(*own, F.array_sort(F.array_distinct(F.flatten(F.filter(marks, lambda m: m.isNotNull())))).alias("__p"))
    steps = F.zip_with("__p", _next(F.col("__p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return rows.select(*own, F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x).alias(out))


def sketch(w: Column, text: Column) -> Column:
    """What a document and its copies are known by: the least md5 of a 3-word window (see SKETCH_LETTERS), or of
    a shorter text."""

    def least(which: Callable[[Column], Column]) -> Column:
        return F.array_min(F.transform(w, lambda x, i: F.when(which(x) & (i < F.size(w) - 2), F.md5(F.concat_ws(" ", x, *_window(w, i)).cast("binary")))))

    long = lambda x: F.length(x) >= SKETCH_LETTERS
    enough = F.size(F.filter(w, long)) * SKETCH_FEW >= F.size(w)
    return F.coalesce(F.when(enough, least(long)), least(lambda x: F.lit(True)), F.md5(text.cast("binary")))


def examined(docs: DataFrame) -> DataFrame:
    """One pass over docs(k, doc_id, host, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, owner (hash of the host), known (sketch), and lines: hash with the host in, and number of words of each."""
    t = F.coalesce(F.col("text"), F.lit(""))
    owner = F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull())
    out = docs.select("k", "doc_id", t.alias("t"), owner.alias("owner"))
    # A line break is white space, so a text's words are its lines' words.
    lines = F.transform(F.split("t", "\n", -1), lambda x: F.struct(x.alias("x"), words(x).alias("w")))
    out = out.select("k", "doc_id", "owner", "t", F.filter(lines, lambda x: F.size(x["w"]) > 0).alias("l"))
    out = out.select("k", "doc_id", "owner", "t", "l", F.flatten("l.w").alias("w"))
    out = out.select(
        "k",
        "doc_id",
        "owner",
        "w",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(_without(F.col("t"), SPACES)).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l.x"))).cast("bigint").alias("n_dup_lines"),
        sketch(F.col("w"), F.col("t")).alias("known"),
        F.transform("l", lambda x: F.struct(F.xxhash64("owner", normalised(x["w"])).alias("h"), F.size(x["w"]).alias("n"))).alias("lines"),
    )
    out = repeat_words(out, "w", "n_repeat_words").drop("w")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def frequent_lines(seen: DataFrame, floor: int = LINE_FLOOR, share: float = LINE_SHARE, most: int = LINE_MOST) -> DataFrame:
    """(h): the lines of examined documents above the limits of their hosts, in distinct documents.

    The first aggregate, by line and sketch, is combined before its shuffle, so a line of a third of all
    documents is no hot key; the second adds up one partial count for each task and line."""
    lines = seen.select("owner", "known", F.explode("lines.h").alias("h")).distinct()
    counts = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("owner").alias("owner")).where(F.col("n") > floor)
    hosts = seen.groupBy("owner").agg(F.count(F.lit(1)).alias("of"))
    return counts.join(hosts, "owner").where((F.col("n") > F.lit(share) * F.col("of")) | (F.col("n") > most)).select("h")


def quality_rules(docs: DataFrame, host: str = "source", floor: int = LINE_FLOOR, share: float = LINE_SHARE, most: int = LINE_MOST, left_share: float = LEFT_SHARE, key: bool = False) -> DataFrame:
    """Base rules and cross-document line frequency.

    In: docs(doc_id, text, host column, any more). Out: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, words_left (words outside frequent lines), kept, and with `key` the row key k,
    xxhash64 of doc_id, text and host. One row per input row; a null text counts as empty and fails the base
    rules; a null host is a host of its own. A line, lower-cased and with digits and white space evened out, is
    frequent in a host where more than `floor` distinct documents and more than `share` of the host's have it, or
    more than `most` however large the host is. Copies, exact or near, are one distinct document (sketch); a line
    counts once in each. Frequent lines are taken out, and a document of which less than `left_share` of the
    words is left is depleted and not kept.

    Texts are read once; what is kept of them, a few numbers a line, is written to the shared folder."""
    docs = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text").withColumn("k", F.xxhash64("doc_id", "text", "host"))
    seen = materialize(examined(docs))
    frequent = materialize(frequent_lines(seen, floor, share, most))
    n = frequent.count()
    frequent = F.broadcast(frequent) if n <= BROADCAST_LINES else frequent
    # Rows repeated whole have one key; each of them brings the same lines, so the sum is divided by their number.
    gone = seen.select("k", F.explode("lines").alias("l")).select("k", "l.*").join(frequent, "h").groupBy("k").agg(F.sum("n").alias("gone"))
    copies = seen.groupBy("k").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    gone = gone.join(copies, "k", "left").select("k", F.expr("gone div coalesce(copies, 1)").alias("gone"))
    rows = seen.join(gone, "k", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    left = F.col("n_words") - F.col("gone")
    kept = ~F.col("base_failed") & (left >= F.lit(left_share) * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", left.alias("words_left"), kept.alias("kept"), *(["k"] if key else []))
