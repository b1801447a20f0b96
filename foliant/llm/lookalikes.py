"""One form for text that looks the same.

Words that hold anything but plain writing are taken once each, exploded to positioned code points, and joined with a
broadcast table of decompositions (canonical ones, and those of full-width forms, ligatures and letter-like signs;
invisible characters become nothing, other spaces and hyphens the plain ones). Combining marks are put in the order of
their class, composed again, and the string is rebuilt. Letters of another script that look alike are then replaced
by those of the script that the rest of the word is written in; codes are always meant in ASCII.

Kept as they are: typographic quotes and dashes, superscripts, fractions, unit and number signs, letter case, words
wholly in another script. Defined results: null stays null, empty stays empty; both are no cases.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.tokens import bucketed_map, look_up
from foliant.tables import cut, looked_up

#: Letters of Cyrillic and Greek that look like the Latin letters below them. Fixed values.
ALIKE = "АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονχιЁё"
LATIN = "ABESIJKMHOPCTYXQWaesijopcyxqwhABEZHIKMNOPTYXovxiËë"
#: Latin and Greek letters that look like the Cyrillic letters below them. Fixed values.
TO_CYRILLIC = "ABEKMHOPCTYXaeopcyxëËΑΒΕΚΜΗΟΡΤΥΧο"
CYRILLIC = "АВЕКМНОРСТУХаеорсухёЁАВЕКМНОРТУХо"
#: Invisible characters, other spaces, other hyphens, letters that look like another one of their script. Fixed values.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
SPACES = "               　"
HYPHENS = "‐‑﹣－"
SAME_SCRIPT = {"Ð": "Đ", "ð": "đ", "ʼ": "'", "ı": "i", "ɡ": "g", "ɑ": "a"}
#: First and last code points of the blocks whose compatibility decompositions look like what they decompose to. Fixed values.
COMPATIBLE = ((0x2160, 0x217F), (0x212A, 0x212B), (0xFB00, 0xFB06), (0xFF01, 0xFFDC), (0x1D400, 0x1D7FF))

PLAIN_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FORM_BUCKETS = 4096
_ODD = (
    rf"[{INVISIBLE}{SPACES}{HYPHENS}{''.join(SAME_SCRIPT)}\p{{M}}\x{{2160}}-\x{{217F}}\x{{212A}}\x{{212B}}\x{{FB00}}-\x{{FB06}}\x{{FF01}}-\x{{FFDC}}\x{{1D400}}-\x{{1D7FF}}]"
    r"|\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}|\p{IsCyrillic}\p{IsGreek}|\p{IsGreek}\p{IsCyrillic}"
)
_WHOLLY_ALIKE = rf"^[{ALIKE}][{ALIKE}0-9]*$|^[0-9]+[{ALIKE}]+$"
_ALIKE_ASCII = r"^[aceopxy]+$"


def decompositions(spark: SparkSession) -> DataFrame:
    """(ch, form): what each character that is not plain stands for, by Unicode's own rules; about 4,000 rows."""
    rows: dict[str, str] = {}
    for code in range(0x80, 0x2FA1E):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        compatible = any(first <= code <= last for first, last in COMPATIBLE)
        form = unicodedata.normalize("NFKD" if compatible else "NFD", char)
        if form != char:
            rows[char] = form
    rows.update({c: "" for c in INVISIBLE} | {c: " " for c in SPACES} | {c: "-" for c in HYPHENS} | SAME_SCRIPT)
    return spark.createDataFrame(pa.table({"ch": list(rows), "form": list(rows.values())}))


def classes(spark: SparkSession) -> DataFrame:
    """(ch, ccc): the combining class of each mark; about 900 rows."""
    marks = [(chr(c), unicodedata.combining(chr(c))) for c in range(0x300, 0x1E94B) if unicodedata.combining(chr(c))]
    return spark.createDataFrame(pa.table({"ch": [m for m, _ in marks], "ccc": pa.array([c for _, c in marks], pa.int32())}))


def compositions(spark: SparkSession) -> Column:
    """A pair of characters to the one composed of them, as one value; about 900 entries."""
    rows = []
    for code in range(0xC0, 0x2FA1E):
        parts = unicodedata.decomposition(chr(code))
        if parts and "<" not in parts and " " in parts:
            pair = "".join(chr(int(p, 16)) for p in parts.split())
            if unicodedata.normalize("NFC", pair) == chr(code):
                rows.append((pair, chr(code)))
    return bucketed_map(spark.createDataFrame(pa.table({"pair": [r[0] for r in rows], "one": [r[1] for r in rows]})), "pair", "one", FORM_BUCKETS)


def _composed(chars: Column, pairs: Column) -> Column:
    """The string of an array of (ch, ccc) with marks in order and composed."""

    def with_marks(state: Column) -> Column:
        # A mark joins the starter unless one of its class, left uncomposed, stands between them.
        folded = F.aggregate(
            F.array_sort(state["marks"]),
            F.struct(state["starter"].alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last")),
            lambda acc, m: F.when(
                (acc["last"] < m["ccc"]) & look_up(pairs, F.concat(acc["s"], m["ch"]), FORM_BUCKETS).isNotNull(),
                F.struct(look_up(pairs, F.concat(acc["s"], m["ch"]), FORM_BUCKETS).alias("s"), acc["rest"].alias("rest"), acc["last"].alias("last")),
            ).otherwise(F.struct(acc["s"].alias("s"), F.concat(acc["rest"], m["ch"]).alias("rest"), m["ccc"].alias("last"))),
        )
        return F.transform(F.array(folded), lambda f: F.concat(state["done"], f["s"], f["rest"]))[0]

    empty = F.array().cast("array<struct<ccc:int,at:int,ch:string>>")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), empty.alias("marks"))

    def step(state: Column, x: Column) -> Column:
        mark = F.array(F.struct(x["ccc"].alias("ccc"), F.size(state["marks"]).alias("at"), x["ch"].alias("ch")))
        return F.when(x["ccc"] > 0, F.struct(state["done"].alias("done"), state["starter"].alias("starter"), F.concat(state["marks"], mark).alias("marks"))).otherwise(
            F.struct(with_marks(state).alias("done"), x["ch"].alias("starter"), empty.alias("marks"))
        )

    return F.aggregate(chars, start, step, with_marks)


def _one_script(piece: Column) -> Column:
    """A word of several scripts in the one whose letters cannot all be look-alikes of the other's."""
    latin, cyrillic = F.translate(piece, ALIKE, LATIN), F.translate(piece, TO_CYRILLIC, CYRILLIC)
    mixed = piece.rlike(r"\p{IsLatin}") & piece.rlike(r"[\p{IsCyrillic}\p{IsGreek}]") | piece.rlike(r"\p{IsCyrillic}") & piece.rlike(r"\p{IsGreek}")
    return F.when(mixed & ~latin.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), latin).when(mixed & ~cyrillic.rlike(r"[\p{IsLatin}\p{IsGreek}]"), cyrillic).otherwise(piece)


def forms(words: DataFrame) -> DataFrame:
    """(word, is_code, form, wholly_alike) of the distinct rows of (word, is_code). ``wholly_alike`` marks words of
    look-alike letters only: ``form`` is what they stand for in a text of the other script."""
    spark = words.sparkSession
    exploded = words.select("word", "is_code", F.posexplode(F.split("word", "")).alias("pos", "ch"))
    mapped = exploded.join(F.broadcast(decompositions(spark)), "ch", "left").select("word", "is_code", "pos", F.coalesce("form", "ch").alias("form"))
    points = mapped.select("word", "is_code", "pos", F.posexplode(F.split("form", "")).alias("sub", "ch")).where("ch <> ''")
    points = points.join(F.broadcast(classes(spark)), "ch", "left")
    held = points.groupBy("word", "is_code").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "ch", F.coalesce("ccc", F.lit(0)).alias("ccc")))).alias("chars"))
    rebuilt = words.join(held, ["word", "is_code"], "left").select("word", "is_code", F.coalesce(_composed(F.col("chars"), compositions(spark)), F.lit("")).alias("form"))
    pieces = F.array_join(F.transform(F.split("form", " "), _one_script), " ")
    wholly = ~F.col("is_code") & F.col("word").rlike(_WHOLLY_ALIKE)
    to_cyrillic = ~F.col("is_code") & F.col("word").rlike(_ALIKE_ASCII)
    form = F.when(F.col("is_code") | wholly, F.translate("form", ALIKE, LATIN)).when(to_cyrillic, F.translate("form", TO_CYRILLIC, CYRILLIC)).otherwise(pieces)
    return rebuilt.select("word", "is_code", form.alias("form"), (wholly | to_cyrillic).alias("wholly_alike"))


def _units(text: Column, is_code: Column) -> Column:
    """What is judged by itself: a code as a whole; of other texts the words beyond ASCII, and where Cyrillic is written
    also those of ASCII letters that look like Cyrillic ones."""
    cyrillic = text.rlike("[\u0400-\u04FF]{4}")
    words = F.filter(F.array_distinct(F.split(text, PLAIN_BREAKS)), lambda u: (F.octet_length(u) > F.length(u)) | cyrillic & u.rlike(_ALIKE_ASCII))
    return F.when(is_code, F.array(text)).otherwise(words)


def find_lookalikes(texts: DataFrame, keys: list[str], text: str, is_code: str) -> DataFrame:
    """(keys, word, form): the words of each text that are not in their one form. A code is one word as a whole."""
    beyond = texts.where(F.octet_length(text) > F.length(text)).select(*keys, F.col(is_code).alias("is_code"), F.col(text).alias("_text"))
    held = beyond.select(*keys, "is_code", "_text", F.explode(_units(F.col("_text"), F.col("is_code"))).alias("word"))
    odd = F.col("is_code") | F.col("word").rlike(_ODD) | F.col("word").rlike(_WHOLLY_ALIKE) | F.col("word").rlike(_ALIKE_ASCII)
    distinct = held.groupBy("word", "is_code").agg(F.lit(None).alias("_")).drop("_").where(odd)
    to = cut(forms(cut(distinct)).where("form <> word or is_code"))
    found = looked_up(held, to, ["word", "is_code"])

    def letters(script: str) -> Column:
        return F.length(F.regexp_replace("_text", rf"[^\p{{Is{script}}}]", ""))

    mostly = F.when(F.col("word").rlike(_ALIKE_ASCII), letters("Cyrillic") > 3 * letters("Latin")).otherwise(letters("Latin") > 3 * (letters("Cyrillic") + letters("Greek") - F.length("word")))
    return found.where(F.when(F.col("wholly_alike"), mostly).otherwise(F.lit(True))).select(*keys, "word", "form").distinct()


def unify(texts: DataFrame, keys: list[str], text: str, is_code: str, found: DataFrame) -> DataFrame:
    """(keys, text): the found texts in their one form."""
    to = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("word", "form"))).alias("_to"))
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[0-9A-Za-z[^\x00-\x7F]]+|" + PLAIN_BREAKS), F.lit(0))
    words = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at("_to", w), w)), "")
    form = F.when(F.col(is_code), F.try_element_at("_to", F.col(text))).otherwise(words)
    return texts.dropDuplicates(keys).join(to, keys).select(*keys, form.alias(text))
