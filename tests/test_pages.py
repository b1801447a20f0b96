import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import legacy, text
from foliant.operators import layout, payloads
from foliant.sources import office


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("a  b\r\n\r\n c\u00a0d ", "a b\nc d"), ("", ""), (None, None), ("\n\n", "")])
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(F.col("t")), t=raw) == clean


def test_text_scalars(spark):
    assert one(spark, text.ustrip(F.col("t")), t="\u2003 x y\x1c") == "x y"
    assert one(spark, text.artifact_folder(F.col("t")), t="C:\\in\\a b.pdf") == "a b"
    assert one(spark, text.artifact_folder(F.col("t")), t="???.pdf").startswith("document-")
    assert one(spark, text.mask_url(F.col("t")), t="postgresql://u:p@ss@h/db") == "postgresql://u:***@h/db"
    assert one(spark, legacy.tcvn3_repair(F.col("t")), t="Ngµy giao hµng") == "Ngày giao hàng"
    assert one(spark, legacy.tcvn3_repair(F.col("t")), t="Nguyên Văn") == "Nguyên Văn"
    assert one(spark, text.route(F.col("t")), t="x.PDF") == "pdf_text" and one(spark, text.route(F.col("t")), t="x.md") is None
    assert len(one(spark, text.compact_error(F.col("t")), t="x " * 300)) <= 220


def test_tables_only(spark):
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, text.tables_only(F.col("t")), t=f"before\n{table}\nafter <table><tr><td>x</td></tr></table>") == f"{table}\n\n<table><tr><td>x</td></tr></table>"
    assert one(spark, text.tables_only(F.col("t")), t="| a |\n| b |") is None and one(spark, text.tables_only(F.col("t")), t="") == ""


def test_pipe_table(spark):
    df = spark.createDataFrame([([["a", "b|c"], [" "], ["1"]],)], "r array<array<string>>")
    assert df.select(text.pipe_table(F.col("r"))).first()[0] == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_word_lines_equal_a_plain_fold(spark):
    rng = random.Random(1)
    words = [(p, x, y, x + rng.uniform(5, 30), y + rng.uniform(4, 14), f"w{i}") for p in range(8) for i in range(25) for x, y in [(rng.uniform(0, 400), rng.choice([10, 24, 40, 55]) + rng.uniform(-3, 3))]]
    expected = set()
    for p in range(8):
        page = sorted(((w[2] + w[4]) / 2, *w[1:]) for w in words if w[0] == p)
        heights = sorted(max(1.0, w[4] - w[2]) for w in page)
        tolerance, lines = max(2.0, 0.65 * heights[len(heights) // 2]), []
        for w in page:
            if lines and abs(w[0] - sum(lines[-1][0]) / len(lines[-1][0])) <= tolerance:
                lines[-1][0].append(w[0])
                lines[-1][1].append(w[5])
            else:
                lines.append(([w[0]], [w[5]]))
        expected |= {(p, i, t) for i, (_, texts) in enumerate(lines) for t in texts}
    df = spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert {(r.page, r.line, r.text) for r in layout.word_lines(df, ["page"]).collect()} == expected
    assert layout.word_lines(df.limit(0), ["page"]).count() == 0


def test_segments_and_table(spark):
    rows = [(0, 72.0 + 150 * c, 10.0 * r, 102.0 + 150 * c, 10.0 * r + 9, f"{r}{c}", r) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, text string, line int")
    segs = layout.segments(df, ["page", "line"])
    assert segs.count() == 9
    assert {(r.row, r.col, r.text) for r in layout.table_cells(segs, ["page"], "line").collect()} == {(r, c, f"{r}{c}") for r in range(3) for c in range(3)}


def cells(spark, *tables):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, t string")
    return [[tuple(c) for c in r.c] if r.c is not None else None for r in df.select("i", payloads.html_cells(F.col("t")).alias("c")).orderBy("i").collect()]


def test_html_cells(spark):
    spans = "<table><tr><td rowspan=2>a</td><td colspan='2'>b &amp; c</td></tr><tr><td>d</td><td> e\n f </td></tr></table>"
    odd = "<TABLE><tr><TH RowSpan='3'>1</TH><td>2</td><td rowspan=2>&#x41;&#66;&lt;</td></tr><tr><td colspan=0>4</td></tr><tr><td>5</td><td>6</td><td>7</td></tr></TABLE>"
    assert cells(spark, spans, odd, "", None, "<tr></tr>") == [
        [(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b & c"), (1, 1, 1, 1, "d"), (1, 2, 1, 1, "e f")],
        [(0, 0, 3, 1, "1"), (0, 1, 1, 1, "2"), (0, 2, 2, 1, "AB<"), (1, 1, 1, 1, "4"), (2, 1, 1, 1, "5"), (2, 2, 1, 1, "6"), (2, 3, 1, 1, "7")],
        [], None, [],
    ]


PAYLOADS = {
    "a": {"res": {"page_index": "nan", "parsing_res_list": [{"block_label": "Doc_Title", "block_content": " T ", "block_bbox": [0, 0, 2, 1], "id": "x1", "order": "2"}, {"label": None, "content": "q"}, {"block_label": "table", "block_content": "<table><tr><td>1</td></tr></table>"}]}},
    "d": [{"text": "x"}, {"text": " "}],
    "e": {"pages": [{"res": {"page_index": 3.7, "boxes": [{"label": "Text", "text": " y ", "score": "0.5", "coordinate": [[1, 2], [3, "4"]]}, 7], "tables": [], "table_res_list": [{"cells": [{"row": 1, "col": "2", "text": "z"}]}, {"html": "<b>w</b>"}]}}, 5]},
    "f": {"pages": []},
    "g": {"markdown": {"text": "m <table><tr><th>1</th></tr></table>"}, "res": {"page_index": 1}},
}


def test_payloads(spark):
    rows = [(k, json.dumps(v)) for k, v in PAYLOADS.items()] + [("b", "no json"), ("c", None)]
    pages = payloads.normalize(spark.createDataFrame(rows, "id string, p string"), "id", "p")
    assert {(r.payload_id, r.page_index) for r in pages.collect()} == {("a", 0), ("d", 0), ("d", 1), ("e", 3), ("g", 1)}
    blocks, tables = payloads.blocks_of(pages), payloads.tables_of(pages)
    found = [(b.payload_id, b.block_type, b.content, len(b.polygon), b.block_order) for b in blocks.orderBy("payload_id", "page_no", "pos").collect()]
    assert found == [("a", "title", "T", 4, 2), ("a", "other", "q", 0, None), ("a", "table", "<table><tr><td>1</td></tr></table>", 0, None), ("d", "text", "x", 0, None), ("d", "text", " ", 0, None), ("e", "text", "y", 2, None)]
    ids = [b.block_id for b in blocks.collect()]
    assert "x1" in ids and len(set(ids)) == len(ids) and sorted(b.block_id for b in payloads.blocks_of(pages).collect()) == sorted(ids)
    got = {(c.payload_id, c.table_no, c.row, c.col, c.text) for c in payloads.cells_of(tables).collect()}
    assert got == {("a", 0, 0, 0, "1"), ("e", 0, 1, 2, "z"), ("e", 1, 0, 0, "w"), ("g", 0, 0, 0, "1")}
    scores = {(r.payload_id, r.page_no): r.confidence for r in payloads.confidences(pages, blocks, tables).collect()}
    assert scores == {("a", 0): 0.9, ("d", 0): 0.9, ("d", 1): 0.0, ("e", 0): 0.5, ("g", 0): 0.0}
    assert payloads.normalize(spark.createDataFrame([], "id string, p string"), "id", "p").count() == 0


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_office_readers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "a.docx").write_bytes(_zip(word__document_dot_xml=body))
    m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = _zip(
        xl__workbook_dot_xml=f'<workbook {m} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        xl__sharedStrings_dot_xml=f"<sst {m}><si><t>shared</t></si></sst>",
        xl__worksheets__s_dot_xml=f'<worksheet {m}><sheetData><row><c r="B1" t="s"><v>0</v></c><c t="b"><v>1</v></c></row><row><c r="A2"/></row></sheetData></worksheet>',
    )
    (tmp_path / "b.xlsx").write_bytes(book)
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("x")
    rows = office.read_files(spark, str(tmp_path)).collect()
    by = {}
    for x in rows:
        by.setdefault(x.path.rsplit("/")[-1], []).append((x.kind, x.text, x.table_col, x.colspan))
    assert by["a.docx"] == [("text", "Hi you", None, None), ("cell", "a", 0, 2), ("cell", "", 2, 1)]
    assert by["b.xlsx"] == [("cell", "shared", 1, 1), ("cell", "TRUE", 2, 1)]
    assert by["c.docx"][0][0] == "error" and set(by) == {"a.docx", "b.xlsx", "c.docx"}
    assert [office.column_index(x, 7) for x in ("A1", "Z9", "AA3", "")] == [0, 25, 26, 7]


def test_streams(spark, tmp_path):
    from foliant.streaming.jobs import batch_writer, rate_breaches

    rows = spark.createDataFrame([("u", "2024-01-01 00:00:05"), ("u", "2024-01-01 00:00:50"), ("v", "2024-01-01 00:01:00")], "user string, t string").select("user", F.col("t").cast("timestamp").alias("t"))
    assert [(r.user, r.requests) for r in rate_breaches(rows, "t", "user", 1).collect()] == [("u", 2)]
    kept = []
    batch_writer(lambda df: kept.extend(df.collect()), ["user"], "t")(rows, 0)
    assert sorted(r.user for r in kept) == ["u", "v"]
