"""Queries of problem 4: block texts and stored Markdown that were read in a wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import encodings
from foliant.tables import table


def texts(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "blocks").select(F.lit("block").alias("src"), F.col("block_no").alias("rec_id"), F.col("content").alias("text"))
    records = table(spark, root, "extractions").select(F.lit("record").alias("src"), F.col("extraction_id").alias("rec_id"), F.col("markdown").alias("text"))
    return blocks.unionByName(records)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return encodings.find_garbled(texts(spark, root), ["src", "rec_id"], "text").select("src", "rec_id").distinct()


def p4_restored(spark: SparkSession, root: str) -> DataFrame:
    all_texts = texts(spark, root)
    return encodings.restore(all_texts, ["src", "rec_id"], "text", encodings.find_garbled(all_texts, ["src", "rec_id"], "text"))


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}

SQL: dict[str, str] = {}
