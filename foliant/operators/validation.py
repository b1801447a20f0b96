"""Deterministic checks of purchase records, as expressions over one line or one record.

Each check gives a struct (field, message, severity) or null. A missing extension skips reconciliation; NaN in an
amount never counts as a difference. The day that dates are held against is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ustrip

#: Least difference that counts, and the share of the amount up to which a difference is rounding.
FLOOR, TOLERANCE = 0.01, 0.01
FIRST_YEAR, DAYS_AHEAD = 2000, 365


def violation(field: Column | str, message: Column | str, severity: str = "error") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(field).alias("field"), as_column(message).alias("message"), F.lit(severity).alias("severity"))


def off_total(quantity: Column, price: Column, extension: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether quantity times price misses the extension by more than the tolerance."""
    difference = F.abs(quantity * price - extension)
    return F.coalesce((difference > F.greatest(F.lit(FLOOR), F.abs(extension) * tolerance)) & ~F.isnan(difference), F.lit(False))


def line_violation(code: Column, quantity: Column, price: Column, extension: Column, path: Column, tolerance: float = TOLERANCE) -> Column:
    """The first thing wrong with a line: code, quantity, price, total."""
    return (
        F.when(F.coalesce(ustrip(code), F.lit("")) == "", violation(path, "the item code is blank"))
        .when(quantity.isNull(), violation(path, "the quantity is missing"))
        .when(price.isNull(), violation(path, "the unit price is missing"))
        .when(quantity <= 0, violation(path, "the quantity must be positive"))
        .when(price < 0, violation(path, "the unit price must not be negative"))
        .when(off_total(quantity, price, extension, tolerance), violation(path, F.format_string("quantity times unit price is %.2f, not %.2f", (quantity * price).cast("double"), extension.cast("double"))))
    )


def date_violation(text: Column, today: Column) -> Column:
    """DD-MM-YYYY, from FIRST_YEAR on, at most DAYS_AHEAD days after ``today``; only the first finding."""
    day = F.try_to_date(F.when(ustrip(text).rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), ustrip(text)), "d-M-yyyy")
    return (
        F.when(day.isNull(), violation("po_date", "the date is not DD-MM-YYYY"))
        .when(F.year(day) < FIRST_YEAR, violation("po_date", "the year is too early"))
        .when(F.datediff(day, today) > DAYS_AHEAD, violation("po_date", "the date is far ahead", "warning"))
    )


def header_violation(po_number: Column, po_date: Column, items: Column) -> Column:
    """Only for records whose items are all right."""
    blank = lambda c: F.coalesce(ustrip(c), F.lit("")) == ""
    return (
        F.when(blank(po_number), violation("po_number", "the number is blank"))
        .when(blank(po_date), violation("po_date", "the date is blank"))
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, violation("items", "there are no items"))
    )


def duplicate_codes(lines: DataFrame, record: str, code: str) -> DataFrame:
    """(record, code, n): codes that stand on several lines of a record."""
    keyed = lines.select(record, ustrip(F.col(code).cast("string")).alias("code")).where("code <> ''")
    return keyed.groupBy(record, "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_record(record: Column, today: Column, tolerance: float = TOLERANCE) -> Column:
    """All violations of a typed record struct (po_number, po_date, items), in the order of the rules."""
    items = F.coalesce(record["items"], F.array())
    lines = F.transform(items, lambda x, i: line_violation(x["toto_number"], x["quantity"], x["unit_price"], x["extension"], F.concat(F.lit("items."), i.cast("string")), tolerance))
    lines = F.filter(lines, lambda v: v.isNotNull())
    header = F.filter(F.array(header_violation(record["po_number"], record["po_date"], items)), lambda v: v.isNotNull())
    codes = F.transform(items, lambda x: ustrip(x["toto_number"]))
    repeated = F.array_sort(F.filter(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)) > 1))
    rules = F.concat(
        F.filter(F.array(date_violation(record["po_date"], today)), lambda v: v.isNotNull()),
        F.transform(repeated, lambda c: violation("items", F.concat(F.lit("repeated code "), c), "warning")),
        F.filter(
            F.transform(items, lambda x, i: F.when(x["unit_price"] == 0, violation(F.concat(F.lit("items."), i.cast("string"), F.lit(".unit_price")), "the unit price is zero", "warning"))),
            lambda v: v.isNotNull(),
        ),
    )
    return F.when(F.size(lines) > 0, lines).when(F.size(header) > 0, header).otherwise(rules)


def replay(attempts: DataFrame, case: str, number: str, valid: str, retries: int = 2) -> DataFrame:
    """(case, attempts, is_valid, healed, used): the loop of answer and correction over recorded answers. It ends at
    the first valid answer; the last recorded one repeats up to the budget of retries."""
    budget = 1 + max(0, retries)
    order = Window.partitionBy(case).orderBy(number)
    ranked = attempts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= budget)
    per_case = ranked.groupBy(case).agg(F.min(F.when(F.col(valid), F.col("_k"))).alias("first_valid"), F.max("_k").alias("answers"))
    used = F.coalesce("first_valid", "answers")
    return per_case.select(
        case, F.coalesce("first_valid", F.lit(budget)).cast("bigint").alias("attempts"), F.col("first_valid").isNotNull().alias("is_valid"),
        F.coalesce(F.col("first_valid") > 1, F.lit(False)).alias("healed"), used.cast("bigint").alias("used"),
    )
