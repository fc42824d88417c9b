"""The queries of this subpackage, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import ann, chat, langid, mixing, neardup, quality, secretscan, spm, substring, tokencount
from rasterloom.llm.common import documents, small_table

#: Where the tokenizer files are; None: the installed package of public tokenizers.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir))


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = small_table(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    conversations = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    segments, _, leaves, members = chat.prefix_tree(conversations)
    return chat.read_conversations(segments, leaves, members)


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(documents(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.poisson_mix(documents(spark, sf_dir))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col("__mix_copies").alias("n_copies"), F.col("__mix_copy").alias("copy_no"), F.col("__mix_order").alias("shuffle_order"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm.sentencepiece_roundtrip(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(documents(spark, sf_dir), size=4, percent=80)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secretscan.secret_scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind_no"] < len(secretscan.BASE_RULES))
    n = [F.size(F.filter("spans", lambda s: s["kind"] == r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in secretscan.BASE_RULES]  # noqa: B023
    return spans.select("doc_id", *n, F.sha2(secretscan.span_text(base), 256).alias("base_sha256"), secretscan.span_text(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_chat_tree, op3_hilbert_ann, op4_substring_dedup, op5_quality_rules, op6_poisson_mix, op7_sentencepiece, op8_minhash_near_dedup, op9_token_counts, op10_secret_scan, pipeline)
}
