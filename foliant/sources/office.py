"""Readers of DOCX and XLSX files, over Spark's binaryFile source.

A file that cannot be read gives one row with ``error`` and no text. Legacy formats and PDF need programs that are not
part of the library; ``adapter`` takes a function for them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import route

SCHEMA = "path string, page_index int, pos int, kind string, text string, table_row int, table_col int, colspan int, error string"
Rows = list[tuple[int, int, str, str, int | None, int | None, int | None]]
#: XML names of the two formats. Fixed values.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _clean(text: str) -> str:
    return "\n".join(line for line in (" ".join(x.split()) for x in re.split(r"\r\n|\r|\n", text)) if line)


def _paragraph(node) -> str:
    shown = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{WORD}t" else shown.get(x.tag, "") for x in node.iter())


def read_docx(content: bytes) -> Rows:
    """The paragraphs and tables of the body in their order, on one page."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORD}body")
    rows: Rows = []
    pos = 0
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p" and (text := _clean(_paragraph(node))):
            rows.append((0, pos, "text", text, None, None, None))
            pos += 1
        elif node.tag == f"{WORD}tbl":
            for r, line in enumerate(node.findall(f"{WORD}tr")):
                column = 0
                for cell in line.findall(f"{WORD}tc"):
                    span = cell.find(f"{WORD}tcPr/{WORD}gridSpan")
                    value = span.get(f"{WORD}val", "1") if span is not None else "1"
                    across = max(1, int(value)) if value.isdigit() else 1
                    rows.append((0, pos, "cell", _clean("\n".join(_paragraph(p) for p in cell.findall(f"{WORD}p"))), r, column, across))
                    column += across
            pos += 1
    return rows


def column_index(reference: str, fallback: int) -> int:
    """The column of a reference such as AB12, from 0."""
    letters = re.match(r"[A-Za-z]+", reference or "")
    if not letters:
        return fallback
    index = 0
    for letter in letters.group().upper():
        index = index * 26 + ord(letter) - 64
    return index - 1


def read_xlsx(content: bytes) -> Rows:
    """The cells of all sheets in workbook order; a page per sheet, blank rows left out."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    texts = lambda node: "".join(t.text or "" for t in node.iter(f"{SHEET}t"))
    shared = [texts(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{SHEET}si")] if "xl/sharedStrings.xml" in archive.namelist() else []
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    rows: Rows = []
    for page, sheet in enumerate(ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET}sheet")):
        target = targets.get(sheet.get(LINK))
        if not target:
            continue
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        number = 0
        for line in ElementTree.fromstring(archive.read(name)).iter(f"{SHEET}row"):
            cells, at = [], -1
            for cell in line.findall(f"{SHEET}c"):
                at = column_index(cell.get("r", ""), at + 1)
                value, kind = cell.findtext(f"{SHEET}v") or "", cell.get("t")
                if kind == "inlineStr":
                    value = texts(cell)
                elif kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                cells.append((at, _clean(value)))
            if any(v for _, v in cells):
                rows += [(page, 0, "cell", v, number, c, 1) for c, v in cells]
                number += 1
    return rows


def read_files(spark: SparkSession, path: str, adapter: Callable[[str, bytes], Rows] | None = None, largest: int = 50 * 1024 * 1024) -> DataFrame:
    """The text and cells of the files below ``path``, see SCHEMA; ``adapter`` reads what is neither DOCX nor XLSX.
    Suffix and size are filtered before any content is touched."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where((F.col("length") <= largest) & route(F.col("path")).isNotNull()).select("path", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame.path, frame.content):
                try:
                    end = name.rpartition(".")[2].lower()
                    found = read_docx(content) if end == "docx" else read_xlsx(content) if end in ("xlsx", "xlsm") else adapter(name, content) if adapter else None
                    if found is None:
                        raise ValueError(f"no reader for .{end}")
                    rows += [(name, *r, None) for r in found]
                except Exception as e:  # a bad file is a row, not the end of the job
                    rows.append((name, 0, 0, "error", None, None, None, None, f"{type(e).__name__}: {e}"[:220]))
            yield pd.DataFrame(rows, columns=["path", "page_index", "pos", "kind", "text", "table_row", "table_col", "colspan", "error"]).astype({c: "Int32" for c in ("table_row", "table_col", "colspan")})

    return files.mapInPandas(read, SCHEMA)


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, expected, attempts, document) of the JSON manifests below ``path``, as JSON strings."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    cases = texts.select(F.explode(F.from_json(F.get_json_object("value", "$.cases"), "array<string>")).alias("c"))
    field = lambda name: F.get_json_object("c", f"$.{name}").alias(name)
    return cases.select(field("case_id"), field("expected"), F.from_json(F.get_json_object("c", "$.attempts"), "array<string>").alias("attempts"), field("document"))


def case_problems(cases: DataFrame) -> DataFrame:
    """(case_id, problem): repeated ids, and cases with neither or both of attempts and document."""
    both = (F.coalesce(F.size("attempts"), F.lit(0)) > 0) == F.col("document").isNotNull()
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", F.lit("repeated id").alias("problem"))
    return cases.where(both | F.col("expected").isNull()).select("case_id", F.lit("incomplete").alias("problem")).unionByName(repeated)
