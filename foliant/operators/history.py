"""The history of stored results: keyed writes, pages, counts and look-ups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ustrip

DEFAULT_PAGE, LARGEST_PAGE = 50, 500


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(LARGEST_PAGE, max(1, DEFAULT_PAGE if limit is None else limit)), max(0, offset or 0)


def matching(records: DataFrame, filters: dict[str, str | None], lines: DataFrame | None = None, record: str = "", line_record: str = "", code: Column | None = None) -> DataFrame:
    """The records that meet all given filters; blank ones are none. ``code`` keeps records with such a line."""
    given = [F.col(k) == v.strip() for k, v in filters.items() if v is not None and v.strip()]
    found = records.where(reduce(and_, given, F.lit(True)))
    if lines is not None and code is not None:
        found = found.join(lines.where(code).select(F.col(line_record).alias(record)), record, "left_semi")
    return found


def page(records: DataFrame, at: str, key: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """The newest records first; a page of bounded length."""
    size, skipped = page_bounds(limit, offset)
    return records.orderBy(F.desc(at), F.desc(key)).offset(skipped).limit(size)


def upsert(rows: DataFrame, keys: list[str], order: list[Column], first: list[str], last: list[str]) -> DataFrame:
    """One row per key of all its writes: columns ``first`` keep the first write, ``last`` have the newest. Two
    aggregates with map-side combination rather than a sort of each key's rows."""
    when = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.withColumn("_at", when).groupBy(*keys).agg(*[F.min_by(c, "_at").alias(c) for c in first], *[F.max_by(c, "_at").alias(c) for c in last])


def flatten_items(records: DataFrame, key: str, items: str) -> DataFrame:
    """(key, line_number, toto_number, customer_number, quantity, unit_price, extension): lines numbered from 1 by
    their place; lines with a blank code are left out and keep their number."""
    flat = records.select(key, F.posexplode(items).alias("pos", "x")).where(F.coalesce(ustrip(F.col("x.toto_number")), F.lit("")) != "")

    def number(name: str) -> Column:
        return F.expr(f"try_cast(x.{name} AS double)")

    blank_to_null = F.nullif(ustrip(F.col("x.customer_number")), F.lit(""))
    return flat.select(
        key, (F.col("pos") + 1).alias("line_number"), ustrip(F.col("x.toto_number")).alias("toto_number"), blank_to_null.alias("customer_number"),
        F.coalesce(number("quantity"), F.lit(0.0)).cast("decimal(18,4)").alias("quantity"),
        F.coalesce(number("unit_price"), F.lit(0.0)).cast("decimal(18,4)").alias("unit_price"), number("extension").cast("decimal(18,4)").alias("extension"),
    )


def replace_items(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The lines after a write: those of ``new`` for keys that have any there, else the old ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def newest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def denormalized(answer: Column) -> tuple[Column, Column]:
    """The number and the day that a record is searched by: the number as stripped text, null if blank; the day where it
    is written DD-MM-YYYY, else null."""
    v = F.try_parse_json(answer)
    text = ustrip(F.try_variant_get(v, "$.po_date", "string"))
    day = F.try_to_date(F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), text), "d-M-yyyy")
    return F.nullif(ustrip(F.try_variant_get(v, "$.po_number", "string")), F.lit("")), day
