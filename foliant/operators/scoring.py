"""Scoring of extracted lines against labelled ones, and the report over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ustrip

ITEM_FIELDS = ("toto_number", "customer_number", "quantity", "unit_price", "extension")


def same_text(a: Column, b: Column) -> Column:
    return F.coalesce(ustrip(a.cast("string")) == ustrip(b.cast("string")), a.isNull() & b.isNull())


def same_number(a: Column, b: Column) -> Column:
    """Equal but for a relative or absolute difference of 1e-9; null equals null only, NaN nothing."""
    near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-9, F.lit(1e-9))
    return F.coalesce((near | (a == b)) & ~F.isnan(a) & ~F.isnan(b), a.isNull() & b.isNull())


def item_key(code: Column) -> Column:
    """A line's code as lines are paired by it: stripped; a null code is a key of its own, named as Python writes it."""
    return F.coalesce(ustrip(code.cast("string")), F.lit("None"))


def align(expected: DataFrame, actual: DataFrame, case: str, code: str, pos: str) -> DataFrame:
    """Lines of equal key paired in their order: a row has ``expected``, ``actual`` or both as structs. Skewed codes
    do not gather, since a key is the case, the code and the line's rank in it."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(F.struct(*df.columns).alias(name), F.col(case), F.col(pos).alias("_pos"), item_key(F.col(code)).alias("_key"))
        inside = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(case, "_key").orderBy("_pos")))
        return inside.select(case, F.col("_key").alias(code), "_rn", name)

    return ranked(expected, "expected").join(ranked(actual, "actual"), [case, code, "_rn"], "full_outer")


def field_results(aligned: DataFrame, case: str, code: str, fields: dict[str, str]) -> DataFrame:
    """(case, code, field, correct): a missed line has all its fields wrong, a spurious one has none."""
    pairs = aligned.where("expected is not null")
    results = []
    for name, kind in fields.items():
        same = (same_number if kind == "number" else same_text)(F.col(f"expected.{name}"), F.col(f"actual.{name}"))
        results.append(F.struct(F.lit(name).alias("field"), (F.col("actual").isNotNull() & same).alias("correct")))
    return pairs.select(case, code, "_rn", F.explode(F.array(*results)).alias("r")).select(case, code, "_rn", "r.field", "r.correct")


HEADER_FIELDS = ("po_number", "po_date")


def header_results(expected: DataFrame, actual: DataFrame, case: str) -> DataFrame:
    """(case, field, correct) of the header fields of each labelled record; a case without an answer has null fields."""
    both = expected.select(case, F.struct(*HEADER_FIELDS).alias("e")).join(actual.select(case, F.struct(*HEADER_FIELDS).alias("a")), case, "left")
    each = [F.struct(F.lit(n).alias("field"), same_text(F.col(f"e.{n}"), F.col(f"a.{n}")).alias("correct")) for n in HEADER_FIELDS]
    return both.select(case, F.explode(F.array(*each)).alias("r")).select(case, "r.field", "r.correct")


def labelled_fields(results: DataFrame, case: str, code: str) -> DataFrame:
    """Item results with their field named after the line: items[CODE].field, items[?] for a blank code."""
    label = F.concat(F.lit("items["), F.when(F.col(code) == "", F.lit("?")).otherwise(F.col(code)), F.lit("]."), F.col("field"))
    return results.select(case, label.alias("field"), "correct")


def case_scores(expected: DataFrame, header: DataFrame, items: DataFrame, aligned: DataFrame, case: str, code: str) -> DataFrame:
    """A row for each case of ``expected``: total and correct fields, accuracy, the codes of missed and spurious lines in
    their order, the wrong fields, and whether all is exact."""
    fields = header.select(case, "field", "correct").unionByName(labelled_fields(items, case, code))
    per_case = fields.groupBy(case).agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if("correct").alias("correct_fields"),
        F.array_sort(F.collect_list(F.when(~F.col("correct"), F.col("field")))).alias("wrong_fields"),
    )
    sides = aligned.groupBy(case).agg(
        F.array_sort(F.collect_list(F.when(F.col("actual").isNull(), F.col(code)))).alias("missed_items"),
        F.array_sort(F.collect_list(F.when(F.col("expected").isNull(), F.col(code)))).alias("spurious_items"),
    )
    none = F.array().cast("array<string>")
    scored = expected.select(case).join(per_case, case, "left").join(sides, case, "left")
    scored = scored.select(
        case, F.coalesce("total_fields", F.lit(0)).alias("total_fields"), F.coalesce("correct_fields", F.lit(0)).alias("correct_fields"),
        F.coalesce("missed_items", none).alias("missed_items"), F.coalesce("spurious_items", none).alias("spurious_items"), F.coalesce("wrong_fields", none).alias("wrong_fields"),
    )
    exact = (F.size("missed_items") == 0) & (F.size("spurious_items") == 0) & (F.col("correct_fields") == F.col("total_fields"))
    accuracy = F.coalesce(F.col("correct_fields") / F.nullif(F.col("total_fields"), F.lit(0)), F.lit(0.0))
    return scored.withColumns({"accuracy": accuracy, "is_exact": exact})


def case_status(is_valid: Column, is_exact: Column, healed: Column, error: Column) -> Column:
    """error, needs_review, healed, exact or wrong (valid, but not what is labelled)."""
    return F.when(error.isNotNull(), "error").when(~is_valid, "needs_review").when(~is_exact, "wrong").when(healed, "healed").otherwise("exact")


def totals(results: DataFrame) -> DataFrame:
    """Pooled over all fields of all cases."""
    correct = F.count_if("correct")
    return results.agg(F.count(F.lit(1)).alias("total_fields"), correct.alias("correct_fields"), F.coalesce(correct / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("accuracy"))


def by_field(results: DataFrame) -> DataFrame:
    """The worst fields first."""
    counted = results.groupBy("field").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("accuracy", F.col("correct") / F.col("total")).orderBy("accuracy", "field")


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Over cases with (attempts, is_valid, healed, is_exact, is_error): counts, recovery rate and mean attempts."""
    first_wrong = ~((F.col("attempts") == 1) & F.col("is_valid"))
    return outcomes.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("is_exact").alias("exact"), F.count_if(~F.col("is_valid")).alias("needs_review"),
        F.count_if(first_wrong).alias("initially_invalid"), F.count_if("healed").alias("recovered"), F.count_if(F.col("is_valid") & ~F.col("is_exact")).alias("silent_failures"),
        F.coalesce(F.count_if("healed") / F.nullif(F.count_if(first_wrong), F.lit(0)), F.lit(0.0)).alias("recovery_rate"), F.coalesce(F.avg("attempts"), F.lit(0.0)).alias("mean_attempts"),
    )
