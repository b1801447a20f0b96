"""Queries of the record, history and scoring operators over the driver's tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import history, records, scoring, validation
from foliant.streaming.jobs import expired, rate_breaches
from foliant.tables import table

TODAY = date(2024, 1, 1)
TODAY_STORED = date(2025, 3, 1)
NEWEST = 50


def _priced_lines(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select("p_partkey", "p_retailprice")
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def line_total_violations(spark: SparkSession, root: str) -> DataFrame:
    lines = _priced_lines(spark, root).where(validation.off_total(F.col("l_quantity"), F.col("p_retailprice"), F.col("l_extendedprice")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def needs_review_latest(spark: SparkSession, root: str) -> DataFrame:
    bad = line_total_violations(spark, root).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("failing_lines"))
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return history.page(orders.join(bad, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey"), "o_orderdate", "o_orderkey", NEWEST)


def po_date_rules(spark: SparkSession, root: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    found = validation.date_violation(text, F.lit(TODAY))
    return table(spark, root, "orders").select("o_orderkey", found["severity"].alias("severity"), found["message"].alias("message"))


def duplicate_item_codes(spark: SparkSession, root: str) -> DataFrame:
    return validation.duplicate_codes(table(spark, root, "lineitem"), "l_orderkey", "l_partkey")


def zero_price_warnings(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "extraction_items").select("extraction_id", "item_id", "line_number", "unit_price").distinct()
    return items.where("unit_price = 0").select("extraction_id", "item_id", F.concat(F.lit("items."), (F.col("line_number") - 1).cast("string"), F.lit(".unit_price")).alias("field"))


def record_lines_checked(spark: SparkSession, root: str) -> DataFrame:
    """The stored lines with the first thing wrong with each."""
    items = table(spark, root, "extraction_items").dropDuplicates(["item_id"])
    found = validation.line_violation(F.col("toto_number"), F.col("quantity").cast("double"), F.col("unit_price").cast("double"), F.col("extension").cast("double"), F.col("line_number").cast("string"))
    return items.select("item_id", found["message"].isNotNull().alias("is_wrong")).where("is_wrong")


def self_heal_outcome(spark: SparkSession, root: str) -> DataFrame:
    """Orders as cases, their lines as answers in turn, an answer right if its discount is small."""
    answers = table(spark, root, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("turn"), (F.col("l_discount") < 0.03).alias("valid"))
    return validation.replay(answers, "l_orderkey", "turn", "valid")


def history_page(spark: SparkSession, root: str) -> DataFrame:
    orders = history.matching(table(spark, root, "orders"), {"o_orderstatus": "O", "o_orderpriority": " "})
    return history.page(orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20, 40)


def history_count(spark: SparkSession, root: str) -> DataFrame:
    return history.matching(table(spark, root, "orders"), {"o_orderstatus": "O"}).agg(F.count(F.lit(1)).alias("total"))


def history_by_item(spark: SparkSession, root: str) -> DataFrame:
    found = history.matching(table(spark, root, "orders"), {}, table(spark, root, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_partkey") == 7)
    return found.select("o_orderkey", "o_orderdate", "o_totalprice")


def history_detail(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "extraction_items").select("extraction_id", "line_number", "toto_number", "quantity").distinct()
    records = table(spark, root, "extractions").select("extraction_id", "request_id", "po_number").distinct()
    return records.join(items, "extraction_id", "left")


def history_upsert(spark: SparkSession, root: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return history.upsert(table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"], order, ["l_shipdate", "l_partkey"], ["l_quantity", "l_extendedprice"])


def line_items_flatten(spark: SparkSession, root: str) -> DataFrame:
    """The lines of every stored record, whatever its status; entries of ``items`` that are no objects keep their number."""
    text = F.try_variant_get
    lines = F.transform(
        records.lines_of(records.parsed(F.col("data_json"))),
        lambda x: F.struct(*(F.when(F.schema_of_variant(x).startswith("OBJECT"), text(x, f"$.{n}", "string")).alias(n) for n in scoring.ITEM_FIELDS)),
    )
    stored = table(spark, root, "extractions").select("extraction_id", "data_json").distinct().select("extraction_id", lines.alias("items"))
    flat = history.flatten_items(stored, "extraction_id", "items")
    return flat.select("extraction_id", F.col("line_number").cast("bigint").alias("line_number"), "toto_number", F.col("quantity").cast("double").alias("quantity"))


def _newest(spark: SparkSession, root: str) -> DataFrame:
    """Each record once, as last delivered."""
    return table(spark, root, "extractions").groupBy("extraction_id").agg(F.max_by("data_json", "ingested_at").alias("data_json"))


def record_violations(spark: SparkSession, root: str) -> DataFrame:
    """Every finding of the typed reading and of the rules, of each stored answer."""
    found = records.answer_findings(F.col("data_json"), F.lit(TODAY_STORED))
    return _newest(spark, root).select("extraction_id", F.posexplode(found).alias("pos", "v")).select("extraction_id", "v.field", "v.severity").distinct()


def correction_digest(spark: SparkSession, root: str) -> DataFrame:
    """How many errors the correction of each failed answer names."""
    found = records.answer_findings(F.col("data_json"), F.lit(TODAY_STORED))
    asked = _newest(spark, root).select("extraction_id", records.correction_text(F.col("data_json"), found).alias("text")).where("text is not null")
    named = F.size(F.regexp_extract_all(F.element_at(F.split("text", "\n\nProblems:\n"), -1), F.lit(r"(?m)^[0-9]+\. field `"), F.lit(0)))
    return asked.select("extraction_id", named.cast("bigint").alias("errors"))


def header_fields(spark: SparkSession, root: str) -> DataFrame:
    """The number and the date that a stored record is found by: text or null, and the day if it is DD-MM-YYYY."""
    number, day = history.denormalized(F.col("data_json"))
    return _newest(spark, root).select("extraction_id", number.alias("po_number"), day.cast("string").alias("po_date"))


def history_store(spark: SparkSession, root: str) -> DataFrame:
    """The store after all deliveries of ``extractions`` in the order of their arrival: one row for each request, what a
    first write sets from the earliest, the rest from the latest."""
    rows = table(spark, root, "extractions")
    return history.upsert(rows, ["request_id"], [F.col("ingested_at"), F.col("extraction_id")], ["created_at"], ["extraction_id", "validation_status", "attempts", "page_count"])


def case_scores(spark: SparkSession, root: str) -> DataFrame:
    """Each stored record against itself with lines moved as in ``_scored`` and every seventh number lost."""
    aligned = _scored(spark, root)
    items = scoring.field_results(aligned, "extraction_id", "toto_number", _FIELDS)
    stored = header_fields(spark, root)
    cases = stored.join(table(spark, root, "extraction_items").select("extraction_id").distinct(), "extraction_id")
    answers = cases.withColumn("po_number", F.when(F.col("extraction_id") % 7 != 0, F.col("po_number")))
    scored = scoring.case_scores(cases, scoring.header_results(cases, answers, "extraction_id"), items, aligned, "extraction_id", "toto_number")
    lists = {name: F.array_join(name, "|") for name in ("missed_items", "spurious_items")}
    return scored.select("extraction_id", "total_fields", "correct_fields", "accuracy", "is_exact", *(v.alias(k) for k, v in lists.items()), F.size("wrong_fields").cast("bigint").alias("wrong_fields"))


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """The stored lines against themselves with every fifth price moved and every ninth line left out."""
    lines = table(spark, root, "extraction_items").select("extraction_id", "line_number", "item_id", "toto_number", "customer_number", F.col("quantity").cast("double").alias("quantity"), F.col("unit_price").cast("double").alias("unit_price")).distinct()
    actual = lines.where("item_id % 9 <> 0").withColumn("unit_price", F.when(F.col("item_id") % 5 == 0, F.col("unit_price") + 1).otherwise(F.col("unit_price")))
    return scoring.align(lines, actual, "extraction_id", "toto_number", "line_number")


_FIELDS = {"toto_number": "text", "customer_number": "text", "quantity": "number", "unit_price": "number"}


def score_items_missed(spark: SparkSession, root: str) -> DataFrame:
    missed = _scored(spark, root).where("actual is null")
    return missed.groupBy("extraction_id", "toto_number").agg(F.count(F.lit(1)).alias("missed"))


def accuracy_by_field(spark: SparkSession, root: str) -> DataFrame:
    return scoring.by_field(scoring.field_results(_scored(spark, root), "extraction_id", "toto_number", _FIELDS))


def eval_totals(spark: SparkSession, root: str) -> DataFrame:
    return scoring.totals(scoring.field_results(_scored(spark, root), "extraction_id", "toto_number", _FIELDS))


def eval_report(spark: SparkSession, root: str) -> DataFrame:
    outcomes = self_heal_outcome(spark, root).withColumn("is_exact", F.col("is_valid") & (F.col("l_orderkey") % 3 != 0))
    return scoring.outcome_report(outcomes)


def rate_limit_breaches(spark: SparkSession, root: str) -> DataFrame:
    return rate_breaches(table(spark, root, "events"), "ts", "user_id", 1)


def retention_expired(spark: SparkSession, root: str) -> DataFrame:
    newest = table(spark, root, "events").groupBy("user_id").agg(F.max("ts").alias("modified"))
    return expired(newest, "modified", datetime(2024, 2, 1), 2)


QUERIES = {
    f.__name__: f
    for f in (
        line_total_violations, needs_review_latest, po_date_rules, duplicate_item_codes, zero_price_warnings, record_lines_checked, self_heal_outcome,
        history_page, history_count, history_by_item, history_detail, history_upsert, line_items_flatten, record_violations, correction_digest, header_fields, history_store, case_scores, score_items_missed, accuracy_by_field,
        eval_totals, eval_report, rate_limit_breaches, retention_expired,
    )
}

_OFF = "abs(l_quantity * p_retailprice - l_extendedprice) > greatest(0.01, abs(l_extendedprice) * 0.01)"
_LINES = f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_OFF}"
_REPLAY = """
    a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, l_discount < 0.03 AS ok FROM lineitem),
    h AS (SELECT l_orderkey, min(k) FILTER (WHERE ok) AS f, max(k) AS n FROM a WHERE k <= 3 GROUP BY l_orderkey),
    o AS (SELECT l_orderkey, coalesce(f, 3) AS attempts, f IS NOT NULL AS is_valid, coalesce(f > 1, false) AS healed, coalesce(f, n) AS used FROM h)
"""
_NEWEST = "newest AS (SELECT extraction_id, arg_max(data_json, ingested_at) AS data_json FROM extractions GROUP BY 1)"
_NUMBER = "nullif(trim(data_json ->> '$.po_number'), '')"
_DAY = "CASE WHEN regexp_matches(trim(data_json ->> '$.po_date'), '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$') THEN try_strptime(trim(data_json ->> '$.po_date'), '%d-%m-%Y')::DATE END"
#: The typed reading in SQL: what is wrong with fields and lines, then the header, then the rules.
_FINDINGS = f"""{_NEWEST},
    i AS (SELECT extraction_id, unnest(json_extract(data_json, '$.items[*]')) AS x, generate_subscripts(json_extract(data_json, '$.items[*]'), 1) - 1 AS k FROM newest WHERE json_type(data_json, '$.items') = 'ARRAY'),
    s AS (SELECT extraction_id, name, json_type(data_json, '$.' || name) AS t FROM newest, (VALUES ('po_number'), ('po_date')) n(name)),
    fields AS (SELECT extraction_id, name AS field FROM s WHERE t IS NULL OR t <> 'VARCHAR'
        UNION ALL SELECT extraction_id, 'items' FROM newest WHERE coalesce(json_type(data_json, '$.items'), '') <> 'ARRAY'
        UNION ALL SELECT extraction_id, unnest(list_filter(json_keys(data_json), lambda y: y NOT IN ('po_number', 'po_date', 'items'))) FROM newest),
    l AS (SELECT extraction_id, k, x, name, json_type(x, '$.' || name) AS t, x ->> ('$.' || name) AS v FROM i, (VALUES ('toto_number'), ('customer_number'), ('quantity'), ('unit_price'), ('extension')) n(name)
        WHERE json_type(x) = 'OBJECT'),
    line_fields AS (SELECT extraction_id, k, 'items.' || k || '.' || name AS field FROM l WHERE t IS NULL OR (t = 'NULL' AND name NOT IN ('customer_number', 'extension'))
            OR (name IN ('toto_number', 'customer_number') AND t NOT IN ('VARCHAR', 'NULL'))
            OR (name NOT IN ('toto_number', 'customer_number') AND (t IN ('ARRAY', 'OBJECT') OR (t = 'VARCHAR' AND try_cast(trim(v) AS DOUBLE) IS NULL)))
        UNION ALL SELECT extraction_id, k, 'items.' || k FROM i WHERE json_type(x) <> 'OBJECT'
        UNION ALL SELECT extraction_id, k, 'items.' || k || '.' || unnest(list_filter(json_keys(x), lambda y: y NOT IN ('toto_number', 'customer_number', 'quantity', 'unit_price', 'extension'))) FROM i WHERE json_type(x) = 'OBJECT'),
    g AS (SELECT extraction_id, k, trim(x ->> '$.toto_number') AS code, try_cast(x ->> '$.quantity' AS DOUBLE) AS q, try_cast(x ->> '$.unit_price' AS DOUBLE) AS p, try_cast(x ->> '$.extension' AS DOUBLE) AS e
        FROM i ANTI JOIN line_fields USING (extraction_id, k)),
    line_rules AS (SELECT extraction_id, 'items.' || k AS field FROM g WHERE code = '' OR q <= 0 OR p < 0 OR abs(q * p - e) > greatest(0.01, abs(e) * 0.01)),
    typed AS (SELECT extraction_id, field FROM fields UNION ALL SELECT extraction_id, field FROM line_fields UNION ALL SELECT extraction_id, field FROM line_rules),
    clean AS (SELECT extraction_id, trim(data_json ->> '$.po_number') AS n, trim(data_json ->> '$.po_date') AS d, json_array_length(data_json, '$.items') AS c FROM newest ANTI JOIN typed USING (extraction_id)),
    header AS (SELECT extraction_id, CASE WHEN n = '' THEN 'po_number' WHEN d = '' THEN 'po_date' ELSE 'items' END AS field FROM clean WHERE n = '' OR d = '' OR c = 0),
    good AS (SELECT extraction_id, d, CASE WHEN regexp_matches(d, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}$') THEN try_strptime(d, '%d-%m-%Y')::DATE END AS day FROM clean ANTI JOIN header USING (extraction_id)),
    every_finding AS (SELECT extraction_id, field, 'error' AS severity FROM typed UNION ALL SELECT extraction_id, field, 'error' FROM header
        UNION ALL SELECT extraction_id, 'po_date', CASE WHEN day IS NULL OR year(day) < 2000 THEN 'error' ELSE 'warning' END FROM good WHERE day IS NULL OR year(day) < 2000 OR day - DATE '2025-03-01' > 365
        UNION ALL SELECT extraction_id, 'items', 'warning' FROM g SEMI JOIN good USING (extraction_id) GROUP BY extraction_id, code HAVING count(*) > 1
        UNION ALL SELECT extraction_id, 'items.' || k || '.unit_price', 'warning' FROM g SEMI JOIN good USING (extraction_id) WHERE p = 0)"""
_SCORED = """
    e AS (SELECT DISTINCT extraction_id, line_number, item_id, toto_number, customer_number, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price FROM extraction_items),
    er AS (SELECT *, row_number() OVER (PARTITION BY extraction_id, toto_number ORDER BY line_number) AS rn FROM e),
    ar AS (SELECT *, row_number() OVER (PARTITION BY extraction_id, toto_number ORDER BY line_number) AS rn
        FROM (SELECT * REPLACE (CASE WHEN item_id % 5 = 0 THEN unit_price + 1 ELSE unit_price END AS unit_price) FROM e WHERE item_id % 9 <> 0)),
    p AS (SELECT er.extraction_id, er.toto_number, ar.item_id IS NOT NULL AS paired, ar.customer_number IS NOT DISTINCT FROM er.customer_number AS c,
        er.quantity = ar.quantity AS q, abs(er.unit_price - ar.unit_price) <= 1e-9 * greatest(er.unit_price, ar.unit_price, 1) AS u
        FROM er LEFT JOIN ar ON er.extraction_id = ar.extraction_id AND er.toto_number = ar.toto_number AND er.rn = ar.rn),
    r AS (SELECT 'toto_number' AS field, paired AS ok FROM p UNION ALL SELECT 'customer_number', paired AND trim(c::VARCHAR) = 'true' FROM p
        UNION ALL SELECT 'quantity', paired AND q FROM p UNION ALL SELECT 'unit_price', paired AND u FROM p)
"""

SQL = {
    "line_total_violations": _LINES,
    "needs_review_latest": f"""WITH b AS (SELECT l_orderkey, count(*) AS failing_lines FROM ({_LINES}) GROUP BY 1)
        SELECT o_orderkey, o_orderdate, o_totalprice, failing_lines FROM orders JOIN b ON o_orderkey = l_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
    "po_date_rules": """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders)
        SELECT o_orderkey, CASE WHEN d IS NULL OR year(d) < 2000 THEN 'error' WHEN d - DATE '2024-01-01' > 365 THEN 'warning' END AS severity,
            CASE WHEN d IS NULL THEN 'the date is not DD-MM-YYYY' WHEN year(d) < 2000 THEN 'the year is too early' WHEN d - DATE '2024-01-01' > 365 THEN 'the date is far ahead' END AS message FROM d""",
    "duplicate_item_codes": "SELECT l_orderkey, l_partkey::VARCHAR AS code, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "zero_price_warnings": "SELECT DISTINCT extraction_id, item_id, 'items.' || (line_number - 1) || '.unit_price' AS field FROM extraction_items WHERE unit_price = 0",
    "record_lines_checked": """SELECT DISTINCT item_id, true AS is_wrong FROM extraction_items WHERE trim(toto_number) = '' OR quantity <= 0 OR unit_price < 0
        OR abs(quantity::DOUBLE * unit_price::DOUBLE - extension::DOUBLE) > greatest(0.01, abs(extension::DOUBLE) * 0.01)""",
    "self_heal_outcome": f"WITH {_REPLAY} SELECT * FROM o",
    "history_page": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "history_count": "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'",
    "history_by_item": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = 7)",
    "history_detail": """SELECT r.extraction_id, request_id, po_number, line_number, toto_number, quantity FROM (SELECT DISTINCT extraction_id, request_id, po_number FROM extractions) r
        LEFT JOIN (SELECT DISTINCT extraction_id, line_number, toto_number, quantity FROM extraction_items) i ON r.extraction_id = i.extraction_id""",
    "history_upsert": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS a,
            row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS z FROM lineitem)
        SELECT l_orderkey, l_linenumber, max(l_shipdate) FILTER (WHERE a = 1) AS l_shipdate, max(l_partkey) FILTER (WHERE a = 1) AS l_partkey,
            max(l_quantity) FILTER (WHERE z = 1) AS l_quantity, max(l_extendedprice) FILTER (WHERE z = 1) AS l_extendedprice FROM r GROUP BY 1, 2""",
    "line_items_flatten": """WITH x AS (SELECT DISTINCT extraction_id, data_json FROM extractions WHERE json_type(data_json, '$.items') = 'ARRAY'),
        i AS (SELECT extraction_id, unnest(json_extract(data_json, '$.items[*]')) AS item, generate_subscripts(json_extract(data_json, '$.items[*]'), 1) AS line_number FROM x)
        SELECT extraction_id, line_number::BIGINT AS line_number, trim(item ->> '$.toto_number') AS toto_number,
            coalesce(try_cast(item ->> '$.quantity' AS DOUBLE), 0)::DECIMAL(18, 4)::DOUBLE AS quantity FROM i WHERE json_type(item) = 'OBJECT' AND trim(coalesce(item ->> '$.toto_number', '')) <> ''""",
    "record_violations": f"WITH {_FINDINGS} SELECT DISTINCT extraction_id, field, severity FROM every_finding",
    "correction_digest": f"WITH {_FINDINGS} SELECT extraction_id, count(*) AS errors FROM every_finding WHERE severity = 'error' GROUP BY 1",
    "header_fields": f"WITH {_NEWEST} SELECT extraction_id, {_NUMBER} AS po_number, ({_DAY})::VARCHAR AS po_date FROM newest",
    "history_store": """SELECT request_id, arg_min(created_at, o) AS created_at, arg_max(extraction_id, o) AS extraction_id, arg_max(validation_status, o) AS validation_status,
        arg_max(attempts, o) AS attempts, arg_max(page_count, o) AS page_count FROM (SELECT *, row_number() OVER (ORDER BY ingested_at, extraction_id) AS o FROM extractions) GROUP BY 1""",
    "case_scores": f"""WITH {_SCORED}, {_NEWEST},
        c AS (SELECT extraction_id, {_NUMBER} AS n FROM newest WHERE extraction_id IN (SELECT extraction_id FROM e)),
        f AS (SELECT extraction_id, CASE WHEN extraction_id % 7 <> 0 THEN true ELSE n IS NULL END AS ok FROM c UNION ALL SELECT extraction_id, true FROM c
            UNION ALL SELECT extraction_id, unnest([paired, paired AND c, paired AND q, paired AND u]) FROM p),
        m AS (SELECT extraction_id, string_agg(toto_number, '|' ORDER BY toto_number) AS missed FROM p WHERE NOT paired GROUP BY 1),
        t AS (SELECT extraction_id, count(*) AS total_fields, count(*) FILTER (WHERE ok) AS correct_fields FROM f GROUP BY 1)
        SELECT extraction_id, total_fields, correct_fields, correct_fields / total_fields AS accuracy, missed IS NULL AND correct_fields = total_fields AS is_exact,
            coalesce(missed, '') AS missed_items, '' AS spurious_items, total_fields - correct_fields AS wrong_fields FROM t LEFT JOIN m USING (extraction_id)""",
    "score_items_missed": f"WITH {_SCORED} SELECT extraction_id, toto_number, count(*) AS missed FROM p WHERE NOT paired GROUP BY 1, 2",
    "accuracy_by_field": f"WITH {_SCORED} SELECT field, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, count(*) FILTER (WHERE ok) / count(*) AS accuracy FROM r GROUP BY 1",
    "eval_totals": f"WITH {_SCORED} SELECT count(*) AS total_fields, count(*) FILTER (WHERE ok) AS correct_fields, count(*) FILTER (WHERE ok) / count(*) AS accuracy FROM r",
    "eval_report": f"""WITH {_REPLAY}, x AS (SELECT *, is_valid AND l_orderkey % 3 <> 0 AS is_exact, NOT (attempts = 1 AND is_valid) AS first_wrong FROM o)
        SELECT count(*) AS cases, count_if(is_exact) AS exact, count_if(NOT is_valid) AS needs_review, count_if(first_wrong) AS initially_invalid, count_if(healed) AS recovered,
            count_if(is_valid AND NOT is_exact) AS silent_failures, count_if(healed) / count_if(first_wrong) AS recovery_rate, avg(attempts) AS mean_attempts FROM x""",
    "rate_limit_breaches": "SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "retention_expired": "SELECT user_id, max(ts) AS modified FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY",
}
