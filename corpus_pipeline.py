"""A corpus from documents: quality rules, near-dedup, secret scans, source mixing, SentencePiece ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm import mixing, neardup, quality, secretscan, spm
from rasterloom.llm.common import documents, materialize, row_key
from rasterloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or depletion reject go."""
    kept = quality.quality_rules(docs, key=True).where("kept").select("k").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text", "source").alias("k"))
    return rows.join(kept, "k", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id, of rows that share it the one with the least key."""
    found = neardup.near_dedup(docs, key=True)
    alone = found.where("kept AND component_id IS NULL").select("k").distinct()  # without an id: no class to choose in
    least = found.where("kept AND component_id IS NOT NULL").groupBy("component_id", F.expr("n_shingles > 0 AS linked"), F.expr("if(n_shingles > 0, 0, k) AS own")).agg(F.min("k").alias("k"))
    kept = least.select("k").unionByName(alone).distinct()
    rows = docs.select(*COLUMNS, row_key().alias("k")).join(kept, "k", "left_semi")
    one = F.row_number().over(Window.partitionBy("k").orderBy("k"))  # rows repeated whole
    return rows.withColumn("n", one).where("n = 1").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each stretch of secrets becomes [SECRET]; n_chars follows."""
    found = secretscan.secret_scan(docs.select(*COLUMNS), carry=True)
    rows = found.select("__row.*", "spans").withColumn("redacted", secretscan.redact(F.col("text"), F.col("spans")))
    n = F.when(F.size("spans") > 0, F.length("redacted").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n.alias("n_chars"))


def poisson_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh the same; a document comes as often as its Poisson count says, in a shuffled order."""
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with the end id, and the text decoded from them."""
    out = spm.sentencepiece_roundtrip(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", poisson_mix),
    ("SentencePiece", sentencepiece),
]

#: Shingles, regular expressions with spans, and BPE can't be put in SQL over whole tables; tests/llm compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if i < len(STAGES) - 1 else docs
    return docs
