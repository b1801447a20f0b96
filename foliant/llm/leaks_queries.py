"""Queries of problem 7: held-out passages in court documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import leaks
from foliant.tables import table


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks.find_leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "holdout_items"), "holdout_id", "text")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", F.col("item_id").alias("holdout_id")).distinct()


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """The corpus without the leaked spans."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    return leaks.without_spans(docs, "doc_id", "text", _leaks(spark, root))


QUERIES = {"p7_found": p7_found, "p7_cleaned": p7_cleaned}

SQL = {
    "p7_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        h AS (SELECT holdout_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM holdout_items),
        dg AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
        hg AS (SELECT DISTINCT holdout_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT holdout_id, w, unnest(range(1, len(w) - 10)) AS i FROM h))
        SELECT DISTINCT doc_id, holdout_id FROM dg JOIN hg USING (g)
    """,
}
