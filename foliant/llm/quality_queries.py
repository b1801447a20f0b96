"""Queries of problem 8: text-quality statistics and the verdict on prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import quality
from foliant.tables import table


def _judged(spark: SparkSession, root: str) -> DataFrame:
    return quality.judge(table(spark, root, "documents"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _judged(spark, root).where(~F.col("is_prose")).select("doc_id")


def p8_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return _judged(spark, root)


def p8_word_counts(spark: SparkSession, root: str) -> DataFrame:
    """The statistics that SQL can state in the same words."""
    stats = quality.statistics(table(spark, root, "documents"), "doc_id", "text", "lang")
    return stats.select("doc_id", F.col("word_count").cast("bigint").alias("word_count"), F.round("mean_word_length", 6).alias("mean_word_length"))


QUERIES = {"p8_found": p8_found, "p8_verdicts": p8_verdicts, "p8_word_counts": p8_word_counts}

SQL = {
    "p8_word_counts": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents WHERE regexp_matches(text, '\S'))
        SELECT doc_id, CAST(len(words) AS BIGINT) AS word_count,
            round(length(array_to_string(words, '')) / greatest(len(words), 1)::DOUBLE, 6) AS mean_word_length
        FROM w
    """,
}
