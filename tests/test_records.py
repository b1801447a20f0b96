from datetime import date

import pytest
from pyspark.sql import functions as F

from foliant.operators import history, scoring, validation

RECORD = "po_number string, po_date string, items array<struct<toto_number:string,customer_number:string,quantity:double,unit_price:double,extension:double>>"
ITEM = ("TX703AR", "CT-9001", 4.0, 1250000.0, 5000000.0)


def found(spark, items=(ITEM,), po="215497", day="05-06-2026"):
    df = spark.createDataFrame([(po, day, list(items))], RECORD)
    return [(v.field, v.severity) for v in df.select(validation.check_record(F.struct("*"), F.lit(date(2026, 8, 1))).alias("v")).first().v]


@pytest.mark.parametrize(
    ("item", "wrong"),
    [
        (ITEM, False), (("TX", None, 4.0, 1250000.0, 500000.0), True), (("TX", None, 7.0, 142857.14, 1000000.0), False), (("TX", None, 4.0, 1250000.0, None), False),
        ((" ", None, 1.0, 1.0, None), True), (("TX", None, 0.0, 1.0, None), True), (("TX", None, 1.0, -5.0, None), True), (("TX", None, float("nan"), 1.0, 1.0), False),
    ],
)
def test_line(spark, item, wrong):
    assert bool(found(spark, [item])) is wrong


@pytest.mark.parametrize(("day", "severity"), [("05-06-2026", []), ("01-07-2027", []), ("2026/06/05", ["error"]), ("05-06-1998", ["error"]), ("05-06-2030", ["warning"]), ("31-02-2026", ["error"]), ("", ["error"])])
def test_date(spark, day, severity):
    assert [s for _, s in found(spark, day=day)] == severity


def test_header_and_warnings(spark):
    assert found(spark, po=" ") == [("po_number", "error")]
    assert found(spark, items=()) == [("items", "error")]
    assert found(spark, [ITEM, ITEM]) == [("items", "warning")]
    assert found(spark, [("A", None, 1.0, 0.0, None)]) == [("items.0.unit_price", "warning")]


def test_replay(spark):
    rows = [("a", 1, True), ("b", 1, False), ("b", 2, True), ("c", 1, False), ("d", 1, False), ("d", 2, False), ("d", 3, False), ("d", 4, True)]
    out = {r.c: (r.attempts, r.is_valid, r.healed) for r in validation.replay(spark.createDataFrame(rows, "c string, k int, ok boolean"), "c", "k", "ok").collect()}
    assert out == {"a": (1, True, False), "b": (2, True, True), "c": (3, False, False), "d": (3, False, False)}


def test_history(spark):
    assert [history.page_bounds(x, -5) for x in (0, -5, 10, 1500, None)] == [(1, 0), (1, 0), (10, 0), (500, 0), (50, 0)]
    rows = spark.createDataFrame([("a", 1, "x", 10), ("a", 2, "y", 20), ("b", 1, None, 5)], "k string, at int, name string, n int")
    assert sorted(map(tuple, history.upsert(rows, ["k"], [F.col("at")], ["name"], ["n"]).collect())) == [("a", "x", 20), ("b", None, 5)]
    kind = "id int, items array<struct<toto_number:string,customer_number:string,quantity:string,unit_price:string,extension:string>>"
    flat = history.flatten_items(spark.createDataFrame([(1, [(" A ", " ", "x", "1250000.5", None), ("", None, "1", "1", "1"), ("B", "c", "2", "3", "bad")]), (2, None)], kind), "id", "items").collect()
    assert [(r.line_number, r.toto_number, r.customer_number, float(r.quantity), r.extension) for r in flat] == [(1, "A", None, 0.0, None), (3, "B", "c", 2.0, None)]


def score(spark, expected, actual):
    kind = "c string, pos int, toto_number string, customer_number string, quantity double"
    make = lambda rows: spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], kind)
    return scoring.align(make(expected), make(actual), "c", "toto_number", "pos")


def test_scoring(spark):
    three = [("A1", "C1", 2.0), ("A2", None, 1.0), ("A3", "C3", 5.0)]
    fields = {"toto_number": "text", "customer_number": "text", "quantity": "number"}
    moved = scoring.field_results(score(spark, three, three[::-1]), "c", "toto_number", fields)
    assert scoring.totals(moved).first().accuracy == 1.0
    dropped = score(spark, three, [three[0], ("A2", "new", 1.0), ("A9", None, 1.0)])
    assert [r.toto_number for r in dropped.where("actual is null").collect()] == ["A3"]
    assert [r.toto_number for r in dropped.where("expected is null").collect()] == ["A9"]
    assert scoring.totals(scoring.field_results(dropped, "c", "toto_number", fields)).first().correct_fields == 5
    swapped = scoring.field_results(score(spark, [("A", "1", 1.0), ("A", "2", 1.0)], [("A", "2", 1.0), ("A", "1", 1.0)]), "c", "toto_number", fields)
    assert scoring.totals(swapped).first().correct_fields == 4
    assert scoring.totals(swapped.limit(0)).first().accuracy == 0.0
