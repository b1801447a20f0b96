"""Queries of problem 3: block texts, cell texts and customer numbers that look the same in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import encodings, encodings_queries, lookalikes
from foliant.tables import table

KEYS = ["src", "rec_id"]


def _texts(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "blocks").select(F.lit("block").alias("src"), F.col("block_no").alias("rec_id"), F.col("content").alias("text"), F.lit(False).alias("is_code"))
    cells = table(spark, root, "table_cells").select(
        F.lit("cell").alias("src"), F.col("cell_no").alias("rec_id"), "text", F.coalesce((F.col("col_idx") == 0) & (F.col("row_idx") > 0), F.lit(False)).alias("is_code")
    )
    items = table(spark, root, "extraction_items").select(F.lit("item").alias("src"), F.col("item_id").alias("rec_id"), F.col("customer_number").alias("text"), F.lit(True).alias("is_code"))
    return blocks.unionByName(cells).unionByName(items)


def _found(spark: SparkSession, root: str, texts: DataFrame) -> DataFrame:
    """A text with a wrongly read encoding is a case of p4 and none here."""
    found = lookalikes.find_lookalikes(texts, KEYS, "text", "is_code")
    garbled = encodings.find_garbled(encodings_queries.texts(spark, root), KEYS, "text").select(*KEYS).distinct()
    return found.join(garbled, KEYS, "left_anti")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _found(spark, root, _texts(spark, root)).select(*KEYS).distinct()


def p3_unified(spark: SparkSession, root: str) -> DataFrame:
    """Texts that p4 restores are left to it: another form of their characters could no longer be restored."""
    texts = _texts(spark, root)
    return lookalikes.unify(texts, KEYS, "text", "is_code", _found(spark, root, texts))


QUERIES = {"p3_found": p3_found, "p3_unified": p3_unified}

SQL: dict[str, str] = {}
