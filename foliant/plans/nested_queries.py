"""Queries of problem 1: nested pages and purchase records as flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import nested
from foliant.tables import table


def _record_nodes(spark: SparkSession, root: str, bodies: bool) -> DataFrame:
    return nested.json_nodes(table(spark, root, "extractions"), "extraction_id", "data_json", "toto_number", bodies)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """One row per block, cell and item; a page or record that is delivered twice counts once."""
    parts = nested.bridge(nested.page_nodes(table(spark, root, "ocr_pages"), bodies=False)).where("entry_key in ('blocks', 'cells')")
    items = nested.bridge(_record_nodes(spark, root, bodies=False)).where("item_no >= 0")
    kinds = ((parts, F.when(F.col("entry_key") == "blocks", "block").otherwise("cell")), (items, F.lit("item")))
    rows = [
        df.select(kind.alias("kind"), F.col("rec_id").alias("parent_id"), F.col("outer_item").cast("bigint").alias("outer_pos"), F.col("item_no").cast("bigint").alias("inner_pos"))
        for df, kind in kinds
    ]
    return rows[0].unionByName(rows[1]).distinct()


def p1_objects(spark: SparkSession, root: str) -> DataFrame:
    """Each distinct object or array of the purchase records, and page, block, table and cell, once, by its Merkle identity."""
    nodes = [_record_nodes(spark, root, bodies=True), nested.page_nodes(table(spark, root, "ocr_pages"))]
    return nested.object_store(nodes[0].select(nodes[1].columns).unionByName(nodes[1])).select("identity", "kind", "body")


def p1_bridge(spark: SparkSession, root: str) -> DataFrame:
    """Every occurrence of those objects, with its parent and ordinal; ``src`` is ``record`` or ``page``."""
    records = nested.bridge(_record_nodes(spark, root, bodies=False)).withColumn("src", F.lit("record"))
    pages = nested.bridge(nested.page_nodes(table(spark, root, "ocr_pages"), bodies=False)).withColumn("src", F.lit("page"))
    return records.unionByName(pages).distinct()


def p1_cells(spark: SparkSession, root: str) -> DataFrame:
    """The flat cells of all pages with their values."""
    cells = nested.page_cells(table(spark, root, "ocr_pages"))
    return cells.select(
        "page_id", F.col("outer_pos").cast("bigint").alias("outer_pos"), F.col("inner_pos").cast("bigint").alias("inner_pos"),
        F.col("cell.row_idx").alias("row_idx"), F.col("cell.col_idx").alias("col_idx"), F.col("cell.text").alias("text"),
    ).distinct()


QUERIES = {"p1_found": p1_found, "p1_objects": p1_objects, "p1_bridge": p1_bridge, "p1_cells": p1_cells}

SQL = {
    "p1_cells": """
        WITH t AS (
            SELECT page_id, unnest(page_tables) AS tab, generate_subscripts(page_tables, 1) - 1 AS outer_pos FROM ocr_pages
        ), c AS (
            SELECT page_id, outer_pos, unnest(tab.cells) AS cell, generate_subscripts(tab.cells, 1) - 1 AS inner_pos FROM t
        )
        SELECT DISTINCT page_id, outer_pos, inner_pos, cell.row_idx AS row_idx, cell.col_idx AS col_idx, cell.text AS text
        FROM c WHERE cell IS NOT NULL
    """,
}
