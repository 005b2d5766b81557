"""Token expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = r"[\p{L}\p{N}]+"
LETTERS = r"\p{L}{3,}"


def words(text: Column) -> Column:
    """Longest runs of letters or digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def letter_terms(text: Column) -> Column:
    """Longest runs of letters, three or more, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def list_values(values: Column) -> Column:
    """Trimmed, lower-cased, non-empty values of a list column."""
    cleaned = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.filter(cleaned, lambda v: v.isNotNull() & (v != ""))


def wide_enough(df: DataFrame) -> DataFrame:
    """Give per-row work at least one partition a core where the scan yields
    fewer; larger inputs stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
