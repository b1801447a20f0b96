"""Queries of problem 6: the corpus as ids of a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import tokens
from foliant.tables import table


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    encoded = tokens.encode(table(spark, root, "documents"), "doc_id", "text")
    return encoded.select("doc_id", F.col("ids").cast("array<bigint>").alias("ids"))


def p6_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """The digest of each text as its ids give it back; a null text comes back empty."""
    encoded = tokens.encode(table(spark, root, "documents"), "doc_id", "text")
    return tokens.decode(encoded, "doc_id", "ids").select("doc_id", F.sha2("text", 256).alias("digest"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}

SQL = {"p6_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents"}
