"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialize

SEED = 17
#: Copies that one draw gives at most; a draw has a mean of at most MAX_MEAN, so the cut tail has a chance below
#: 1e-30. A larger mean is the sum of several draws.
MAX_COPIES, MAX_MEAN = 200, 64.0
#: Copies of a document that is drawn several times are dealt out in blocks of this many.
BLOCK_COPIES = 1000
#: Source statistics are broadcast up to this many sources (by their counted number), else joined by shuffle.
BROADCAST_SOURCES = 20_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the md5 of the parts joined by ':'."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_below(mean: Column) -> Column:
    """P(X <= n) for n = 0 to MAX_COPIES - 1 as an array, each probability from the one before,
    as far as a draw may reach."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("below"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["below"], F.array(F.element_at(s["below"], -1) + p)).alias("below"))

    below = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COPIES - 1)), start, step, lambda s: s["below"])
    # A number drawn is at most 1 - 2**-48: greater probabilities are never met and only lengthen the search.
    return F.filter(below, lambda p: p <= F.lit(1 - 2.0**-48))


def poisson_count(u: Column, below: Column) -> Column:
    """Inverse of the Poisson distribution function at u: the least n with P(X <= n) > u."""
    return F.size(F.filter(below, lambda p: p <= u))


def source_means(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, mean): repetition rates that bring each source's expected documents to its weight's part of `total`.

    Without weights, all sources found weigh the same; sources that weights doesn't name get none.
    Without total, the expected size of the mixture is the number of documents."""
    spark = docs.sparkSession
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        rows = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        counts = counts.join(F.broadcast(rows), counts["source"].eqNullSafe(rows["source"]), "left").select(counts["source"], "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    counts = materialize(counts)  # a row for each source
    sums = counts.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    goal = float(sums["n"] if total is None else total)
    if not sums["w"] > 0:
        return counts.select("source", F.lit(0.0).alias("mean"))
    return counts.select("source", (F.col("w") / F.lit(float(sums["w"])) * F.lit(goal) / F.col("n")).alias("mean"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """Explode each document by a Poisson count with its source's mean repetition rate, and shuffle globally.

    In: docs(doc_id, source, any more). Out: all columns of docs as they are, and __mix_copy (int, from 1),
    __mix_copies (int), __mix_order (double in [0, 1), the order of the shuffle). The count is a function of
    seed and doc_id: rows that repeat a doc_id get equal counts. A null source is a source of its own, a null
    doc_id hashes as `null`. Columns of docs with these names are replaced. An empty table gives none.

    Means may be of any size: independent draws with means of at most MAX_MEAN are added up."""
    keep = [c for c in docs.columns if c not in ("__mix_copy", "__mix_copies", "__mix_order")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    means = source_means(docs.select(F.col("source").cast("string").alias("source")), weights, total)
    found = means.agg(F.count(F.lit(1)).alias("n"), F.max("mean").alias("most")).first()
    large = (found["most"] or 0) > MAX_MEAN
    means = means.select(F.col("source").alias("__mix_source"), F.greatest(F.ceil(F.col("mean") / MAX_MEAN), F.lit(1)).cast("int").alias("__mix_draws"), "mean")
    means = means.select("__mix_source", "__mix_draws", poisson_below(F.col("mean") / F.col("__mix_draws")).alias("__mix_below"))

    def counted(means: DataFrame, n: Column) -> DataFrame:
        means = F.broadcast(means) if found["n"] <= BROADCAST_SOURCES else means
        rows = docs.join(means, F.col("source").cast("string").eqNullSafe(F.col("__mix_source")))
        return rows.select(*(F.col(f"`{c}`") for c in keep), n.cast("int").alias("__mix_copies")).where("__mix_copies > 0")

    below = F.col("__mix_below")
    rows = counted(means.where("__mix_draws = 1"), poisson_count(unit(F.lit(seed), F.col("doc_id")), below))
    rows = rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    if large:
        draws = F.sequence(F.lit(1), F.col("__mix_draws"))
        n = F.aggregate(draws, F.lit(0).cast("bigint"), lambda s, i: s + poisson_count(unit(F.lit(seed), F.col("doc_id"), F.lit("draw"), i), below))
        blocks = counted(means.where("__mix_draws > 1"), n)
        blocks = blocks.withColumn("__mix_block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((__mix_copies - 1) div {BLOCK_COPIES} as int)"))))
        blocks = blocks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "__mix_block")
        first = F.col("__mix_block") * BLOCK_COPIES
        copies = blocks.withColumn("__mix_copy", F.explode(F.sequence(first + 1, F.least(first + BLOCK_COPIES, F.col("__mix_copies")))))
        rows = rows.unionByName(copies.drop("__mix_block"))
    rows = rows.withColumn("__mix_order", unit(F.lit(seed), F.col("doc_id"), F.col("__mix_copy"), F.lit("order")))
    if not shuffle:
        return rows
    # The order is uniform in [0, 1), so equal ranges of it are even: no sampling pass is needed.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(parts, F.floor(F.col("__mix_order") * parts).cast("int")).sortWithinPartitions("__mix_order", "doc_id", "__mix_copy")


