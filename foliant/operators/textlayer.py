"""Whether the text layer of a document can be used, judged over its pages.

Defined results: a document all of whose pages are without text is not usable; a null page text counts as empty; page
texts are joined without anything between them, in the order of ``page`` and then of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as texts

#: Least useful characters of a document and of each page, least share of readable ones, words from which the share of
#: corrupt ones counts, and its most. Fixed values.
DOCUMENT_CHARS, PAGE_CHARS, READABLE, WORDS, CORRUPT = 80, 40, 0.7, 20, 0.07


def page_text(blocks: str):  # noqa: ANN201
    """The texts of a page's blocks, one to a line."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: F.coalesce(b["content"], F.lit(""))), lambda t: t != ""), "\n")


def judge(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, pages, text, chars, readable, considered, corrupt, usable) of each document."""
    body = F.coalesce(text, F.lit(""))
    per_document = pages.groupBy(document).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(texts.useful_chars(body)).alias("chars"), F.min(texts.useful_chars(body)).alias("least"),
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), body.alias("body")))).alias("_pages"),
    )
    joined = per_document.withColumn("text", F.array_join(F.transform("_pages", lambda p: p["body"]), "")).drop("_pages")
    considered, corrupt = texts.word_counts(F.col("text"))
    counted = joined.withColumns({"readable": texts.readable_ratio(F.col("text")), "considered": considered, "corrupt": corrupt})
    sound = (F.col("considered") < WORDS) | (F.col("corrupt") <= CORRUPT * F.col("considered"))
    usable = (F.col("chars") >= DOCUMENT_CHARS) & (F.col("least") >= PAGE_CHARS) & (F.col("readable") >= READABLE) & sound
    return counted.withColumn("usable", F.coalesce(usable, F.lit(False))).drop("least")
