"""Typed reading of purchase records from JSON answers, with every field that is not of its type.

Numbers may come as strings of digits or as true and false; text must be text; a key that is missing is another finding
than null; keys beyond the known ones are findings. Rules over values are asked only where all fields are of their type,
and rules over the whole record only where no line has a finding.

Defined results: a null answer has no record and no findings; a text that is no JSON object has one finding at
``(root)``; NaN is no JSON number and makes the answer such a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import ustrip
from foliant.operators.validation import TOLERANCE, check_record, header_violation, line_violation, violation

#: Fields of a record and of its lines: kind, and whether null is allowed. Fixed values.
HEADER = {"po_number": ("text", False), "po_date": ("text", False)}
LINE = {"toto_number": ("text", False), "customer_number": ("text", True), "quantity": ("number", False), "unit_price": ("number", False), "extension": ("number", True)}

MISSING, EXTRA = "Field required", "Extra inputs are not permitted"
NO_TEXT, NO_NUMBER, NO_LIST, NO_OBJECT = "Input should be a valid string", "Input should be a valid number", "Input should be a valid list", "Input should be an object"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _member(v: Column, name: str) -> Column:
    return F.variant_get(v, f"$.{name}", "variant")


def as_number(v: Column) -> Column:
    """A number, a trimmed string of one, or a truth value as a double, else null."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(_kind(v) == "STRING", ustrip(text).try_cast("double")).when(_kind(v).startswith("ARRAY") | _kind(v).startswith("OBJECT"), None).otherwise(F.try_variant_get(v, "$", "double"))


def as_text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _field_finding(v: Column, name: str, path: Column, kind: str, nullable: bool) -> Column:
    value = _member(v, name)
    wrong = as_text(value).isNull() if kind == "text" else as_number(value).isNull()
    of_type = F.when(F.is_variant_null(value), F.lit(not nullable)).otherwise(wrong)
    return F.when(value.isNull(), violation(path, MISSING)).when(of_type, violation(path, NO_TEXT if kind == "text" else NO_NUMBER))


def _extra(v: Column, known: list[str], prefix: Column) -> Column:
    keys = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, known)))
    return F.transform(F.array_sort(F.coalesce(keys, F.array().cast("array<string>"))), lambda k: violation(F.concat(prefix, k), EXTRA))


def _found(*findings: Column) -> Column:
    return F.filter(F.array(*findings), lambda f: f.isNotNull())


def line_findings(v: Column, path: Column, tolerance: float = TOLERANCE) -> Column:
    """The findings of one line at ``path``: all of its fields, else the first rule that it breaks."""
    prefix = F.concat(path, F.lit("."))
    fields = F.concat(_found(*(_field_finding(v, n, F.concat(prefix, F.lit(n)), *spec) for n, spec in LINE.items())), _extra(v, list(LINE), prefix))
    t = typed_line(v)
    broken = _found(line_violation(t["toto_number"], t["quantity"], t["unit_price"], t["extension"], path, tolerance))
    return F.when(~_is_object(v), F.array(violation(path, NO_OBJECT))).when(F.size(fields) > 0, fields).otherwise(broken)


def typed_line(v: Column) -> Column:
    return F.struct(*((as_text if kind == "text" else as_number)(_member(v, n)).alias(n) for n, (kind, _) in LINE.items()))


def parsed(answer: Column) -> Column:
    """The answer as a variant, null if it is no JSON."""
    return F.try_parse_json(answer)


def lines_of(v: Column) -> Column:
    """The entries of ``items`` as variants; no entries where it is no list."""
    items = _member(v, "items")
    return F.when(_kind(items).startswith("ARRAY"), F.variant_get(items, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def typed_record(v: Column) -> Column:
    return F.struct(as_text(_member(v, "po_number")).alias("po_number"), as_text(_member(v, "po_date")).alias("po_date"), F.transform(lines_of(v), typed_line).alias("items"))


def findings(v: Column, today: Column, tolerance: float = TOLERANCE) -> Column:
    """All findings of a parsed answer in their order: fields, lines, keys beyond the known ones; where there is none,
    the record's own, and else those of the rules over dates, codes and prices."""
    items = _member(v, "items")
    no_list = F.when(items.isNull(), violation("items", MISSING)).when(~F.coalesce(_kind(items).startswith("ARRAY"), F.lit(False)), violation("items", NO_LIST))
    fields = _found(*(_field_finding(v, n, F.lit(n), *spec) for n, spec in HEADER.items()), no_list)
    lines = F.flatten(F.transform(lines_of(v), lambda x, i: line_findings(x, F.concat(F.lit("items."), i.cast("string")), tolerance)))
    every = F.concat(fields, lines, _extra(v, [*HEADER, "items"], F.lit("")))
    record = typed_record(v)
    header = _found(header_violation(record["po_number"], record["po_date"], record["items"]))
    rules = check_record(record, today, tolerance)
    return F.when(~_is_object(v), F.array(violation("(root)", NO_OBJECT))).when(F.size(every) > 0, every).when(F.size(header) > 0, header).otherwise(rules)


def answer_findings(answer: Column, today: Column, tolerance: float = TOLERANCE) -> Column:
    v = parsed(answer)
    return F.when(answer.isNotNull(), F.when(v.isNull(), F.array(violation("(root)", NO_OBJECT))).otherwise(findings(v, today, tolerance)))


def correction_text(answer: Column, found: Column) -> Column:
    """What to ask after a failed answer: the answer and its errors, numbered. Null if nothing blocks."""
    errors = F.filter(found, lambda f: f["severity"] == "error")
    numbered = F.array_join(F.transform(errors, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". field `"), f["field"], F.lit("`: "), f["message"])), "\n")
    return F.when(F.size(errors) > 0, F.concat(F.lit("The last answer is not valid. Read the document again and correct what is wrong.\n\nLast answer:\n"), answer, F.lit("\n\nProblems:\n"), numbered))
