"""Text scalars as Column functions. Null stays null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python means it, of which Java's Unicode class lacks the four separators. Fixed values.
BLANK = r"(?U)[\s\x1c-\x1f]"
#: Longest error text that is kept whole.
ERROR_CHARS = 220
#: Labels by what they contain, in the order of precedence. Fixed values.
LABELS = (
    ("table", ("table",)), ("formula", ("formula", "equation")), ("chart", ("chart", "figure")), ("seal", ("seal", "stamp")),
    ("title", ("title",)), ("text", ("text", "paragraph", "line", "word")),
)
#: Suffixes that can be read. Fixed values.
SUFFIXES = ("pdf", "doc", "docx", "xls", "xlsx", "xlsm", "png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")


def ustrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{BLANK}+$|^{BLANK}+".replace("|^(?U)", "|^"), "")


def one_line(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{BLANK}+", " "))


def useful_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, rf"{BLANK}+", ""))


def readable_ratio(c: Column) -> Column:
    """Share of the non-space characters that are letters, marks, numbers, punctuation or symbols; 0 without any."""
    readable = F.length(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}\p{P}\p{S}]|�", ""))
    return F.when(useful_chars(c) > 0, readable / useful_chars(c)).otherwise(F.lit(0.0))


def word_counts(c: Column) -> tuple[Column, Column]:
    """(words of two letters or more, those of them with fewer digits than letters but at least one)."""
    words = F.split(F.trim(c), rf"{BLANK}+")
    considered = F.filter(words, lambda w: w.rlike(r"\p{L}\P{L}*\p{L}"))
    corrupt = F.filter(considered, lambda w: w.rlike(r"\p{Nd}") & (F.regexp_count(w, F.lit(r"\p{Nd}")) < F.regexp_count(w, F.lit(r"\p{L}"))))
    return F.size(considered), F.size(corrupt)


def clean_text(c: Column) -> Column:
    """Each line with single spaces, blank lines left out."""
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), one_line)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def pad_row(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(row))))


def pipe_row(row: Column) -> Column:
    cells = F.transform(row, lambda x: F.replace(F.replace(clean_text(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def pipe_table(rows: Column) -> Column:
    """An array of rows as a pipe table: blank rows out, all rows as wide as the widest, the first one as heading."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda x: ustrip(x) != ""))
    width = F.array_max(F.transform(kept, F.size))
    padded = F.transform(kept, lambda r: pipe_row(pad_row(r, width)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.greatest(F.lit(0), F.size(padded) - 1)))
    return F.when(F.size(kept) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def compact_error(c: Column) -> Column:
    flat = one_line(c)
    return F.when(F.length(flat) > ERROR_CHARS, F.concat(F.rtrim(F.substring(flat, 1, ERROR_CHARS - 3)), F.lit("..."))).otherwise(flat)


def label_type(c: Column) -> Column:
    label = F.lower(F.trim(c))
    out = F.lit("other")
    for name, parts in reversed(LABELS):
        found = F.lit(False)
        for part in parts:
            found = found | label.contains(part)
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def suffix(path: Column) -> Column:
    """The lower-case suffix without its dot; empty if there is none."""
    return F.regexp_extract(F.lower(path), r"\.([^./\\]+)$", 1)


def route(path: Column) -> Column:
    """Which reader takes a file; a PDF goes to the text layer first and to recognition if that is unusable."""
    s = suffix(path)
    return F.when(s.isin("doc", "docx"), "word").when(s.isin("xls", "xlsx", "xlsm"), "excel").when(s == "pdf", "pdf_text").when(s.isin(*SUFFIXES), "ocr")


def _raw_stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1), r"(?<=.)\.[^.]*$", "")


def artifact_stem(name: Column) -> Column:
    """A file name for the results of an upload: its own without its suffix and what file systems refuse."""
    safe = F.regexp_replace(F.regexp_replace(_raw_stem(name), r'[<>:"/\\|?*\x00-\x1f]', ""), r"^[ .]+|[ .]+$", "")
    return F.when(safe == "", "document").otherwise(safe)


def artifact_folder(name: Column) -> Column:
    """The folder of an upload's results; a hash tells apart names that had to be changed."""
    raw, safe = _raw_stem(name), artifact_stem(name)
    return F.when(safe == raw, safe).otherwise(F.concat(safe, F.lit("-"), F.sha2(raw, 256)))


def mask_url(c: Column) -> Column:
    """A database address without its password; the last at sign ends the credentials."""
    return F.regexp_replace(c, r"^([^:/]+://[^:/@]*):.*@", "$1:***@")


#: A marker of a page; openings that stand apart. Fixed values.
PAGE_MARKER = r"^(?:#{1,6}\s*)?\[(?:Tr\.|Page)\s*\d+\s*\]\s*:?"
STANDS_APART = r"(?iu)^Ngày(?![\p{L}\p{N}_])|(?-i)^(?:Người dịch:|Hiệu đính:|VIỆN )"
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def compact_markdown(c: Column) -> Column:
    """Prose without its blank lines, but for one before a page marker, after a heading, and before a date or a fixed
    opening; none follows a marker that stands alone. Texts with tables or code are only stripped; null where nothing is
    left. The rule for a line reads the kept line before it."""
    lines = F.filter(F.transform(F.split(c, LINE_ENDS), ustrip), lambda x: x != "")

    def apart(x: Column, before: Column) -> Column:
        return F.when(x.rlike(PAGE_MARKER), True).when(before.rlike(rf"{PAGE_MARKER}\s*$"), False).otherwise(before.startswith("#") | x.rlike(STANDS_APART))

    spaced = F.transform(lines, lambda x, i: F.when((i > 0) & apart(x, F.get(lines, i - 1)), F.concat(F.lit("\n"), x)).otherwise(x))
    structured = c.contains("<table") | c.contains("```") | c.rlike(r"(?m)^\s*\|.*\|\s*$")
    return F.nullif(F.when(structured, ustrip(c)).otherwise(F.array_join(spaced, "\n")), F.lit(""))


def tables_only(c: Column) -> Column:
    """The HTML tables and pipe tables of a Markdown text in their order, null if it has none. A pipe table is a run
    of at least three pipe rows with a dash rule among them."""
    row = r"[ \t]*\|[^\n]*\|[ \t]*"
    pattern = rf"(?is)<table\b[^>]*>.*?</table>|(?:(?<=\n)|^){row}(?:\n{row}){{2,}}"
    found = F.filter(
        F.regexp_extract_all(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit(pattern), F.lit(0)),
        lambda t: t.rlike(r"(?i)^<table") | t.rlike(r"(?m)^[ \t]*\|[ \t:|-]*-[ \t:|-]*\|[ \t]*$"),
    )
    return F.when(c == "", c).when(F.size(found) > 0, F.array_join(found, "\n\n"))
