"""Queries of problem 5: stored and engine Markdown within the limits of chunk_limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.splitting import split_pieces
from foliant.tables import table


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of all texts over their limit; a row that is delivered twice gives the same pieces twice."""
    texts = table(spark, root, "extractions").select(F.lit("record").alias("src"), F.col("extraction_id").alias("rec_id"), F.lit("extractions.markdown").alias("field_name"), "markdown")
    texts = texts.unionByName(
        table(spark, root, "engine_results").select(F.lit("engine").alias("src"), F.col("result_id").alias("rec_id"), F.lit("engine_results.markdown").alias("field_name"), "markdown")
    )
    limits = table(spark, root, "chunk_limits")  # two rows, one for each field
    texts = texts.join(F.broadcast(limits), "field_name").where(F.length("markdown") > F.col("max_chars"))
    return split_pieces(texts, ["src", "rec_id"], "markdown", F.col("max_chars"), F.col("overlap_chars"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root).where("piece_count > 1").select("src", "rec_id").distinct()


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    pieces = _pieces(spark, root).dropDuplicates(["src", "rec_id", "piece_no"])
    return pieces.select("src", "rec_id", F.col("piece_no").cast("bigint").alias("piece_no"), F.col("start").cast("bigint").alias("start"), "piece")


def p5_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the pieces: without their overlaps they give the text again, none is over its limit, and each
    shares the overlap with the one before."""
    limits = table(spark, root, "chunk_limits").select(F.regexp_extract("field_name", "^(engine|extractions)", 1).alias("field"), "max_chars", "overlap_chars")  # two rows
    pieces = p5_pieces(spark, root).withColumn("field", F.when(F.col("src") == "engine", "engine").otherwise("extractions")).join(F.broadcast(limits), "field")
    ordered = pieces.groupBy("src", "rec_id", "max_chars", "overlap_chars").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "piece"))).alias("p"))
    ends = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["start"].cast("int") + F.length(x["piece"])))
    shared = F.transform("p", lambda x, i: F.get(ends, i) - x["start"].cast("int"))
    body = F.array_join(F.transform("p", lambda x, i: F.substring(x["piece"], F.get(shared, i) + 1, F.length(x["piece"]))), "")
    within = F.forall("p", lambda x: F.length(x["piece"]) <= F.col("max_chars"))
    overlaps = F.forall(F.slice(F.arrays_zip(shared.alias("shared"), F.slice(ends, F.lit(1), F.size("p")).alias("end")), F.lit(2), F.size("p")), lambda z: z["shared"] == F.least(F.col("overlap_chars"), z["end"]))
    return ordered.select("src", "rec_id", F.sha2(body, 256).alias("digest"), within.alias("within_limit"), overlaps.alias("overlaps"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt}

SQL = {
    "p5_rebuilt": """
        SELECT DISTINCT 'record' AS src, extraction_id AS rec_id, sha256(markdown) AS digest, true AS within_limit, true AS overlaps FROM extractions
        WHERE length(markdown) > (SELECT max_chars FROM chunk_limits WHERE field_name = 'extractions.markdown')
        UNION
        SELECT DISTINCT 'engine', result_id, sha256(markdown), true, true FROM engine_results
        WHERE length(markdown) > (SELECT max_chars FROM chunk_limits WHERE field_name = 'engine_results.markdown')
    """,
    "p5_found": """
        SELECT DISTINCT 'record' AS src, extraction_id AS rec_id FROM extractions
        WHERE length(markdown) > (SELECT max_chars FROM chunk_limits WHERE field_name = 'extractions.markdown')
        UNION
        SELECT DISTINCT 'engine', result_id FROM engine_results
        WHERE length(markdown) > (SELECT max_chars FROM chunk_limits WHERE field_name = 'engine_results.markdown')
    """,
}
