"""Queries of the text, layout and payload operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import legacy, text
from foliant.operators import layout, payloads, textlayer
from foliant.tables import table


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "text")


def useful_chars(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).select("doc_id", F.col("text").isNull().alias("is_null"), text.useful_chars(F.col("text")).alias("chars"))


def readable_ratio(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).select("doc_id", F.round(text.readable_ratio(F.col("text")), 9).alias("ratio"))


def text_usable(spark: SparkSession, root: str) -> DataFrame:
    """The gate on a text layer, each document one page."""
    considered, corrupt = text.word_counts(F.col("text"))
    counted = _documents(spark, root).select("doc_id", text.useful_chars(F.col("text")).alias("chars"), text.readable_ratio(F.col("text")).alias("readable"), considered.alias("considered"), corrupt.alias("corrupt"))
    usable = (F.col("chars") >= 80) & (F.col("readable") >= 0.7) & ((F.col("considered") < 20) | (F.col("corrupt") <= 0.07 * F.col("considered")))
    return counted.select("doc_id", F.coalesce(usable, F.lit(False)).alias("usable"))


def tcvn3_repair(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).select("doc_id", F.sha2(legacy.tcvn3_repair(F.col("text")), 256).alias("digest"))


def clean_text(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("digest"))


def compact_markdown(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "extractions").select("extraction_id", text.compact_markdown(F.col("markdown")).alias("markdown")).distinct()


def tables_only(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "extractions").select("extraction_id", text.tables_only(F.col("markdown")).alias("tables"))
    return found.where("tables <> ''").distinct()


def pipe_table_render(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.col("n_nationkey").cast("string"), F.col("n_name")))).alias("rows"))
    return rows.select("n_regionkey", text.pipe_table(F.col("rows")).alias("markdown"))


def label_to_type(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", text.label_type(F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 4 == 0, " Table").when(F.col("p_partkey") % 4 == 1, " figure").otherwise(""))).alias("kind"))


def file_routes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "extractions").select("extraction_id", text.suffix(F.col("source_filename")).alias("suffix"), text.route(F.col("source_filename")).alias("reader")).distinct()


def artifact_names(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "extractions").select("extraction_id", text.artifact_folder(F.col("source_filename")).alias("stem")).distinct()


def page_confidence(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "ocr_pages").select("page_id", "confidence", F.explode_outer("blocks").alias("b")).groupBy("page_id").agg(
        F.max("confidence").alias("score"), F.avg(F.when(F.col("b.confidence") > 0, F.col("b.confidence"))).alias("blocks")
    )
    return pages.select("page_id", F.round(layout.page_confidence(F.col("score"), F.lit(None).cast("double"), F.col("blocks"), F.lit(0.0), F.lit(False)), 9).alias("confidence"))


def reading_order(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "blocks").select("block_no", "request_id", "page_index", "pos", "bbox").dropDuplicates(["block_no"])
    placed = blocks.withColumn("c", layout.centroid(F.col("bbox"))).withColumn("order", F.when(F.col("block_no") % 3 == 0, F.col("pos")))
    ranked = layout.reading_order(placed.withColumns({"cx": F.round("c.x", 6), "cy": F.round("c.y", 6)}), ["request_id", "page_index"], "order", "cy", "cx", "block_no")
    return ranked.select("block_no", F.col("rank").cast("bigint").alias("rank"))


def _words(spark: SparkSession, root: str) -> DataFrame:
    """Cells as words on a grid: a line per table row."""
    cells = table(spark, root, "table_cells").select("cell_no", "table_id", "request_id", "row_idx", "col_idx", "text").dropDuplicates(["cell_no"]).where("text is not null")
    x = F.col("col_idx") * 90.0 + F.col("cell_no") % 7
    return cells.select("request_id", "table_id", "row_idx", "cell_no", x.alias("x0"), (F.col("row_idx") * 22.0).alias("y0"), (x + 60.0).alias("x1"), (F.col("row_idx") * 22.0 + 10).alias("y1"), "text")


def word_lines(spark: SparkSession, root: str) -> DataFrame:
    return layout.word_lines(_words(spark, root), ["request_id", "table_id"])


def line_segments(spark: SparkSession, root: str) -> DataFrame:
    segs = layout.segments(_words(spark, root), ["request_id", "table_id", "row_idx"])
    return segs.select("request_id", "table_id", "row_idx", F.col("segment").cast("bigint").alias("segment"), "x0", "x1")


def affine_points(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "ocr_pages").where("size(geometry.original.affine) = 6").select("page_id", F.posexplode("blocks").alias("pos", "b"), F.col("geometry.original.affine").alias("t"))
    moved = pages.where("b.bbox is not null").select("page_id", "pos", F.posexplode(layout.affine(F.col("b.bbox"), F.col("t"))).alias("corner", "p"))
    return moved.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("corner").cast("bigint").alias("corner"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")).distinct()


def text_layer_usable(spark: SparkSession, root: str) -> DataFrame:
    """The gate over the stored pages of each request."""
    pages = table(spark, root, "ocr_pages").drop("ingested_at").dropDuplicates(["page_id"]).select("request_id", "page_index", textlayer.page_text("blocks").alias("text"))
    judged = textlayer.judge(pages, "request_id", "page_index", "text")
    return judged.select("request_id", F.col("pages").cast("bigint").alias("pages"), F.col("chars").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"), "usable")


def _payloads(spark: SparkSession, root: str) -> DataFrame:
    """The stored pages as an engine would send them: boxes with their points and lists of cells, as JSON."""
    box = F.transform("blocks", lambda b: F.when(b.isNotNull(), F.struct(b["block_type"].alias("label"), b["content"].alias("text"), b["confidence"].alias("score"), F.transform(b["bbox"], lambda p: F.array(p["x"], p["y"])).alias("coordinate"))))
    cell = lambda c: F.struct(c["row_idx"].alias("row"), c["col_idx"].alias("col"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), c["text"].alias("text"))
    tables = F.transform("page_tables", lambda t: F.when(t.isNotNull(), F.struct(t["confidence"].alias("score"), F.transform(t["cells"], lambda c: F.when(c.isNotNull(), cell(c))).alias("cells"))))
    pages = table(spark, root, "ocr_pages").drop("ingested_at").dropDuplicates(["page_id"])
    return payloads.normalize(pages.select("page_id", F.to_json(F.struct("page_index", F.col("confidence").alias("score"), box.alias("boxes"), tables.alias("tables"))).alias("payload")), "page_id", "payload")


def payload_blocks(spark: SparkSession, root: str) -> DataFrame:
    blocks = payloads.blocks_of(_payloads(spark, root))
    return blocks.select(F.col("payload_id").cast("bigint").alias("page_id"), "page_index", F.col("pos").cast("bigint").alias("pos"), "block_type", "content", F.size("polygon").cast("bigint").alias("points"), "confidence")


def payload_cells(spark: SparkSession, root: str) -> DataFrame:
    cells = payloads.cells_of(payloads.tables_of(_payloads(spark, root)))
    return cells.select(F.col("payload_id").cast("bigint").alias("page_id"), F.col("table_no").cast("bigint").alias("table_no"), F.col("cell_no").cast("bigint").alias("cell_no"), "row", "col", "rowspan", "colspan", "text")


def payload_confidence(spark: SparkSession, root: str) -> DataFrame:
    pages = _payloads(spark, root)
    found = payloads.confidences(pages, payloads.blocks_of(pages), payloads.tables_of(pages))
    return found.select(F.col("payload_id").cast("bigint").alias("page_id"), F.round("confidence", 9).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        useful_chars, readable_ratio, text_usable, text_layer_usable, tcvn3_repair, clean_text, compact_markdown, payload_blocks, payload_cells, payload_confidence, tables_only, pipe_table_render, label_to_type, file_routes,
        artifact_names, page_confidence, reading_order, word_lines, line_segments, affine_points,
    )
}

_WS = r"[\s\x0B\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOKENS = rf"list_filter(string_split_regex(trim(text), '{_WS}+'), lambda w: len(regexp_extract_all(w, '\p{{L}}')) >= 2)"
_READABLE = rf"length(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}]|\x{{FFFD}}', '', 'g'))"
_USEFUL = f"length(regexp_replace(text, '{_WS}+', '', 'g'))"
_CORRUPT = rf"list_filter({_TOKENS}, lambda w: len(regexp_extract_all(w, '\p{{Nd}}')) >= 1 AND len(regexp_extract_all(w, '\p{{Nd}}')) < len(regexp_extract_all(w, '\p{{L}}')))"
_SUFFIX = r"regexp_extract(lower(source_filename), '\.([^./\\]+)$', 1)"

_PAGES = "p AS (SELECT DISTINCT ON (page_id) * FROM ocr_pages)"
_BOXES = "b AS (SELECT page_id, page_index, unnest(list_filter(blocks, lambda x: x IS NOT NULL)) AS b, generate_subscripts(list_filter(blocks, lambda x: x IS NOT NULL), 1) - 1 AS pos FROM p)"
_TABLES = "t AS (SELECT page_id, unnest(list_filter(page_tables, lambda x: x IS NOT NULL)) AS t, generate_subscripts(list_filter(page_tables, lambda x: x IS NOT NULL), 1) - 1 AS table_no FROM p)"

_LAYER = f"""d AS (SELECT request_id, count(*) AS pages, sum({_USEFUL}) AS chars, min({_USEFUL}) AS least, string_agg(text, '' ORDER BY page_index NULLS FIRST, text) AS text
        FROM (SELECT request_id, page_index, coalesce(array_to_string(list_filter(list_transform(blocks, lambda b: b.content), lambda c: c <> ''), chr(10)), '') AS text FROM p) GROUP BY 1)"""

SQL = {
    "text_layer_usable": f"""WITH p AS (SELECT DISTINCT ON (page_id) * FROM ocr_pages), {_LAYER},
        w AS (SELECT *, {_TOKENS} AS words FROM d),
        c AS (SELECT *, len(words) AS considered, len(list_filter(words, lambda w: len(regexp_extract_all(w, '\\p{{Nd}}')) >= 1 AND len(regexp_extract_all(w, '\\p{{Nd}}')) < len(regexp_extract_all(w, '\\p{{L}}')))) AS corrupt FROM w)
        SELECT request_id, pages, chars::BIGINT AS chars, sha256(text) AS digest,
            chars >= 80 AND least >= 40 AND {_READABLE} / {_USEFUL} >= 0.7 AND (considered < 20 OR corrupt <= 0.07 * considered) AS usable FROM c""",
    "tables_only": r"""SELECT DISTINCT extraction_id, array_to_string(list_filter(regexp_extract_all(replace(markdown, chr(13) || chr(10), chr(10)),
            '(?ims)<table\b[^>]*>.*?</table>|^[ \t]*\|[^\n]*\|[ \t]*(?:\n[ \t]*\|[^\n]*\|[ \t]*){2,}'),
            lambda t: regexp_matches(t, '(?i)^<table') OR regexp_matches(t, '(?m)^[ \t]*\|[ \t:|-]*-[ \t:|-]*\|[ \t]*$')), chr(10) || chr(10)) AS tables
        FROM extractions WHERE tables <> ''""".replace("\\\\", "\\"),
    "payload_blocks": f"""WITH {_PAGES}, {_BOXES}
        SELECT page_id, coalesce(page_index, 0)::INTEGER AS page_index, pos::BIGINT AS pos, CASE WHEN b.block_type IN ('table', 'formula', 'chart', 'seal', 'title', 'text') THEN b.block_type ELSE 'other' END AS block_type,
            trim(coalesce(b.content, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8199) || chr(8239) || chr(12288) || chr(8195) || chr(8201) || chr(8202)) AS content,
            len(coalesce(list_filter(b.bbox, lambda x: x IS NOT NULL), [])) AS points, coalesce(b.confidence, 0) AS confidence FROM b""",
    "payload_cells": f"""WITH {_PAGES}, {_TABLES},
        c AS (SELECT page_id, table_no, unnest(list_filter(t.cells, lambda x: x IS NOT NULL)) AS c, generate_subscripts(list_filter(t.cells, lambda x: x IS NOT NULL), 1) - 1 AS cell_no FROM t)
        SELECT page_id, table_no, cell_no, coalesce(c.row_idx, 0) AS row, coalesce(c.col_idx, 0) AS col, coalesce(c.rowspan, 1) AS rowspan, coalesce(c.colspan, 1) AS colspan, coalesce(c.text, '') AS text FROM c""",
    "payload_confidence": f"""WITH {_PAGES}, {_BOXES},
        m AS (SELECT page_id, avg(b.confidence) FILTER (WHERE b.confidence > 0) AS mean, avg((trim(coalesce(b.content, '')) <> '')::INTEGER) AS share FROM b GROUP BY 1)
        SELECT page_id, round(coalesce(nullif(confidence, 0), mean, CASE WHEN share > 0 THEN least(0.9, 0.55 + 0.35 * share + CASE WHEN len(list_filter(page_tables, lambda x: x IS NOT NULL)) > 0 THEN 0.05 ELSE 0 END) END, 0), 9) AS confidence
        FROM p LEFT JOIN m USING (page_id)""",
    "compact_markdown": r"""
        WITH t AS (SELECT DISTINCT extraction_id, markdown AS m,
            list_filter(list_transform(regexp_split_to_array(markdown, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]'),
                lambda x: regexp_replace(x, '^[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')), lambda x: x <> '') AS l FROM extractions),
        s AS (SELECT extraction_id, m, list_transform(l, lambda x, i: CASE WHEN i > 1 AND (CASE
                WHEN regexp_matches(x, '^(#{1,6}\s*)?\[(Tr\.|Page)\s*\d+\s*\]\s*:?') THEN true
                WHEN regexp_matches(l[i - 1], '^(#{1,6}\s*)?\[(Tr\.|Page)\s*\d+\s*\]\s*:?\s*$') THEN false
                ELSE starts_with(l[i - 1], '#') OR regexp_matches(x, '(?i)^ngày([^\p{L}\p{N}_]|$)') OR regexp_matches(x, '^(Người dịch:|Hiệu đính:|VIỆN )') END)
                THEN chr(10) || x ELSE x END) AS l FROM t)
        SELECT extraction_id, nullif(CASE WHEN contains(m, '<table') OR contains(m, '```') OR regexp_matches(m, '(?m)^\s*\|.*\|\s*$')
            THEN regexp_replace(m, '^[\s\x1C-\x1F\x{85}\x{A0}]+|[\s\x1C-\x1F\x{85}\x{A0}]+$', '', 'g') ELSE array_to_string(l, chr(10)) END, '') AS markdown FROM s
    """,
    "useful_chars": f"SELECT doc_id, text IS NULL AS is_null, {_USEFUL} AS chars FROM documents",
    "readable_ratio": f"SELECT doc_id, round(CASE WHEN {_USEFUL} > 0 THEN {_READABLE} / {_USEFUL}::DOUBLE ELSE 0 END, 9) AS ratio FROM documents",
    "text_usable": f"""SELECT doc_id, coalesce({_USEFUL} >= 80 AND {_READABLE} / greatest(1, {_USEFUL}) >= 0.7
        AND (len({_TOKENS}) < 20 OR len({_CORRUPT}) <= 0.07 * len({_TOKENS})), false) AS usable FROM documents""",
    "tcvn3_repair": f"""SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '[{legacy.TCVN3_MARKERS}]') THEN translate(text, '{legacy.TCVN3}', '{legacy.VIETNAMESE}') ELSE text END) AS digest FROM documents""",
    "clean_text": f"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM documents""",
    "pipe_table_render": """WITH r AS (SELECT n_regionkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey::VARCHAR) AS k FROM nation),
        s AS (SELECT n_regionkey, k * 2 AS k, line FROM r UNION ALL SELECT DISTINCT n_regionkey, 3, '| --- | --- |' FROM r)
        SELECT n_regionkey, string_agg(line, chr(10) ORDER BY k) AS markdown FROM s GROUP BY 1""",
    "label_to_type": """WITH l AS (SELECT p_partkey, lower(p_type || CASE p_partkey % 4 WHEN 0 THEN ' Table' WHEN 1 THEN ' figure' ELSE '' END) AS l FROM part)
        SELECT p_partkey, CASE WHEN l LIKE '%table%' THEN 'table' WHEN l LIKE '%formula%' OR l LIKE '%equation%' THEN 'formula' WHEN l LIKE '%chart%' OR l LIKE '%figure%' THEN 'chart'
            WHEN l LIKE '%seal%' OR l LIKE '%stamp%' THEN 'seal' WHEN l LIKE '%title%' THEN 'title' WHEN l LIKE '%text%' OR l LIKE '%paragraph%' OR l LIKE '%line%' OR l LIKE '%word%' THEN 'text' ELSE 'other' END AS kind FROM l""",
    "file_routes": f"""SELECT DISTINCT extraction_id, {_SUFFIX} AS suffix, CASE WHEN {_SUFFIX} IN ('doc', 'docx') THEN 'word' WHEN {_SUFFIX} IN ('xls', 'xlsx', 'xlsm') THEN 'excel'
        WHEN {_SUFFIX} = 'pdf' THEN 'pdf_text' WHEN {_SUFFIX} IN ('png', 'jpg', 'jpeg', 'bmp', 'webp', 'tif', 'tiff') THEN 'ocr' END AS reader FROM extractions""",
    "artifact_names": r"""WITH r AS (SELECT DISTINCT extraction_id, regexp_replace(source_filename, '\.[^.]*$', '') AS raw FROM extractions),
        s AS (SELECT *, regexp_replace(regexp_replace(raw, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '^[ .]+|[ .]+$', '', 'g') AS safe FROM r)
        SELECT extraction_id, CASE WHEN safe = raw THEN safe ELSE CASE safe WHEN '' THEN 'document' ELSE safe END || '-' || sha256(raw) END AS stem FROM s""",
    "page_confidence": """WITH b AS (SELECT page_id, confidence, unnest(CASE WHEN len(blocks) > 0 THEN blocks ELSE [NULL] END) AS b FROM ocr_pages),
        a AS (SELECT page_id, max(confidence) AS s, avg(b.confidence) FILTER (WHERE b.confidence > 0) AS m FROM b GROUP BY 1)
        SELECT page_id, round(coalesce(nullif(s, 0), nullif(m, 0), 0), 9) AS confidence FROM a""",
    "reading_order": """WITH b AS (SELECT DISTINCT ON (block_no) block_no, request_id, page_index, pos, bbox FROM blocks),
        c AS (SELECT *, round(coalesce(list_sum(list_transform(bbox, lambda p: p.x)) / greatest(len(bbox), 1), 0), 6) AS cx,
            round(coalesce(list_sum(list_transform(bbox, lambda p: p.y)) / greatest(len(bbox), 1), 0), 6) AS cy FROM b)
        SELECT block_no, row_number() OVER (PARTITION BY request_id, page_index ORDER BY CASE WHEN block_no % 3 = 0 THEN pos ELSE 1000000000 END, cy, cx, block_no) - 1 AS rank FROM c""",
    "line_segments": """WITH c AS (SELECT DISTINCT ON (cell_no) cell_no, table_id, request_id, row_idx, col_idx, text FROM table_cells WHERE text IS NOT NULL),
        w AS (SELECT *, col_idx * 90.0::DOUBLE + cell_no % 7 AS x0, col_idx * 90.0::DOUBLE + cell_no % 7 + 60.0::DOUBLE AS x1 FROM c),
        g AS (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY request_id, table_id, row_idx ORDER BY x0, x1, text) > 12.5)::INT, 0) AS n FROM w),
        s AS (SELECT *, sum(n) OVER (PARTITION BY request_id, table_id, row_idx ORDER BY x0, x1, text ROWS UNBOUNDED PRECEDING) AS segment FROM g)
        SELECT request_id, table_id, row_idx, segment::BIGINT AS segment, min(x0) AS x0, max(x1) AS x1 FROM s GROUP BY 1, 2, 3, 4""",
    "affine_points": """WITH b AS (SELECT page_id, geometry.original.affine AS t, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS pos FROM ocr_pages WHERE len(geometry.original.affine) = 6),
        p AS (SELECT page_id, pos, t, unnest(b.bbox) AS p, generate_subscripts(b.bbox, 1) - 1 AS corner FROM b)
        SELECT DISTINCT page_id, pos, corner, round(t[1] * p.x + t[2] * p.y + t[3], 6) AS x, round(t[4] * p.x + t[5] * p.y + t[6], 6) AS y FROM p""",
}
