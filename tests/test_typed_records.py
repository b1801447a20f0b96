import json
from datetime import date

from pyspark.sql import functions as F

from foliant.functions.text import compact_markdown
from foliant.operators import history, records, scoring


def found(spark, answers):
    df = spark.createDataFrame(list(enumerate(answers)), "id int, j string")
    rows = df.select("id", records.answer_findings(F.col("j"), F.lit(date(2025, 3, 1))).alias("f")).collect()
    return {r.id: None if r.f is None else [(v.field, v.severity) for v in r.f] for r in rows}


def line(**changes):
    return {"toto_number": "A1", "customer_number": None, "quantity": 2, "unit_price": 3.5, "extension": 7} | changes


def record(*lines, **changes):
    return json.dumps({"po_number": "12", "po_date": "01-02-2025", "items": list(lines)} | changes)


def test_findings(spark):
    cases = [
        (record(line()), []), (record(line(quantity=" 4 ", extension="14")), []), (record(line(quantity=True, extension=None)), []),
        (record(line(quantity="1,000")), [("items.0.quantity", "error")]), (record(line(toto_number=5)), [("items.0.toto_number", "error")]),
        (record(line(quantity=None, unit_price=None)), [("items.0.quantity", "error"), ("items.0.unit_price", "error")]),
        (record({k: v for k, v in line().items() if k != "extension"}), [("items.0.extension", "error")]),
        (record(line(uom="kg"), extra=1), [("items.0.uom", "error"), ("extra", "error")]), (record(line(), 7), [("items.1", "error")]),
        (record(line(), po_number=215497), [("po_number", "error")]), (record(), [("items", "error")]), (record(line(), items={"1": 2}), [("items", "error")]),
        (record(line(), po_number=" "), [("po_number", "error")]), (record(line(quantity=0), po_number=" "), [("items.0", "error")]),
        (record(line(toto_number=" ")), [("items.0", "error")]), (record(line(extension=8)), [("items.0", "error")]),
        (record(line(), po_date="2025/01/02"), [("po_date", "error")]), (record(line(), line(toto_number=" A1 ")), [("items", "warning")]),
        (record(line(unit_price=0, extension=0)), [("items.0.unit_price", "warning")]), ("[1]", [("(root)", "error")]), ("no json", [("(root)", "error")]), ("", [("(root)", "error")]),
        ("{}", [("po_number", "error"), ("po_date", "error"), ("items", "error")]), (None, None),
    ]
    out = found(spark, [a for a, _ in cases])
    assert [out[i] for i in range(len(cases))] == [want for _, want in cases]
    assert found(spark, []) == {}


def test_correction_names_only_errors(spark):
    df = spark.createDataFrame([(record(line(quantity=0), line(uom=1)),), (record(line()),), (None,)], "j string")
    f = records.answer_findings(F.col("j"), F.lit(date(2025, 3, 1)))
    a, b, c = (r.t for r in df.select(records.correction_text(F.col("j"), f).alias("t")).collect())
    assert "1. field `items.0`: " in a and "2. field `items.1.uom`: Extra" in a and record(line(quantity=0), line(uom=1)) in a and b is None and c is None


def test_case_scores(spark):
    schema = "c int, pos int, code string, quantity double"
    expected = spark.createDataFrame([(1, 0, " A ", 1.0), (1, 1, "A", 2.0), (1, 2, None, 3.0), (2, 0, "B", 1.0), (3, 0, "", 1.0)], schema)
    actual = spark.createDataFrame([(1, 0, "A", 1.0), (1, 1, "A ", 5.0), (1, 2, None, 3.0), (2, 0, "C", 1.0), (3, 0, " ", 1.0)], schema)
    aligned = scoring.align(expected, actual, "c", "code", "pos")
    items = scoring.field_results(aligned, "c", "code", {"quantity": "number"})
    heads = spark.createDataFrame([(1, "7", None), (2, "8", "d"), (3, "9", "d"), (4, "x", None)], "c int, po_number string, po_date string")
    header = scoring.header_results(heads, heads.where("c <> 4"), "c")
    out = {r.c: r for r in scoring.case_scores(heads, header, items, aligned, "c", "code").collect()}
    assert (out[1].total_fields, out[1].correct_fields, out[1].wrong_fields, out[1].missed_items) == (5, 4, ["items[A].quantity"], [])
    assert (out[2].missed_items, out[2].spurious_items, out[2].is_exact) == (["B"], ["C"], False)
    assert out[3].is_exact and out[3].accuracy == 1.0 and out[4].correct_fields == 1


def test_denormalized(spark):
    rows = [('{"po_number": " 7 ", "po_date": "5-6-2026"}',), ('{"po_number": 12, "po_date": "2026-06-05"}',), ('{"po_number": "", "po_date": null}',), ("no",), (None,)]
    number, day = history.denormalized(F.col("j"))
    out = [(r.n, r.d) for r in spark.createDataFrame(rows, "j string").select(number.alias("n"), day.alias("d")).collect()]
    assert out == [("7", date(2026, 6, 5)), ("12", None), (None, None), (None, None), (None, None)]


def test_compact_markdown(spark):
    cases = [
        ("a\n\n\n b \n[Page 2]\nc", "a\nb\n\n[Page 2]\nc"), ("# H\n\ntext\n# I", "# H\n\ntext\n# I"), ("## [Tr. 3]:\n\nx", "## [Tr. 3]:\nx"),
        ("x\nngày 3\nNgàynay\nVIỆN A\nviện b", "x\n\nngày 3\nNgàynay\n\nVIỆN A\nviện b"), (" \n", None), (None, None), ("a\n\n| b |\n", "a\n\n| b |"), ("x\r\n\r\n```y", "x\r\n\r\n```y"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    out = {r.i: r.o for r in df.select("i", compact_markdown(F.col("t")).alias("o")).collect()}
    assert [out[i] for i in range(len(cases))] == [w for _, w in cases]
