"""Encoder options as (case_id, format, key, value) rows: duplicates, unknown keys, typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.catalog import OPTION_KEYS


def key_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, k) for f, keys in OPTION_KEYS.items() for k in keys], "format string, key string")


def duplicate_keys(options: DataFrame) -> DataFrame:
    return options.groupBy("case_id", "format", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_keys(options: DataFrame) -> DataFrame:
    """Anti-join against the catalog, a table of a few dozen rows."""
    return options.join(F.broadcast(key_catalog(options.sparkSession)), ["format", "key"], "left_anti")


def first_error(options: DataFrame) -> DataFrame:
    """(case_id, error): a duplicate key before an unknown one, the first of each by name; null if all are fine."""
    dup = duplicate_keys(options).groupBy("case_id").agg(F.min("key").alias("dup"))
    unknown = unknown_keys(options).groupBy("case_id").agg(F.min("key").alias("unknown"))
    cases = options.select("case_id").distinct().join(dup, "case_id", "left").join(unknown, "case_id", "left")
    error = F.when(F.col("dup").isNotNull(), F.concat(F.lit("duplicate "), "dup")).when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown "), "unknown"))
    return cases.select("case_id", error.alias("error"))


def parse_bool(value: Column) -> Column:
    """true/1/yes/on and false/0/no/off in any case; null for anything else."""
    v = F.lower(value)
    return F.when(v.isin("true", "1", "yes", "on"), True).when(v.isin("false", "0", "no", "off"), False)


def parse_number(value: Column, low: int, high: int) -> Column:
    n = F.when(value.rlike(r"^\+?[0-9]{1,18}$"), F.regexp_replace(value, r"^\+", "")).try_cast("bigint")
    return F.when((n >= low) & (n <= high), n)


def parse_hex(value: Column) -> Column:
    """Bytes of an even number of hex digits; null for anything else."""
    return F.when(value.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(value))
