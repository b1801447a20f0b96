"""Geometry of words, lines and blocks on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNORDERED = 1_000_000_000
#: Words belong to one line within this share of the median height, at least LEAST_LINE; a gap beyond GAP times the
#: line's median height, at least LEAST_GAP, starts a new segment; a layout column is COLUMN units wide.
LINE_SHARE, LEAST_LINE, GAP, LEAST_GAP, COLUMN = 0.65, 2.0, 1.25, 12.0, 6.0


def word_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, x0, y0, x1, y1, text) of words with a box: a word joins the last line if its middle lies within
    the tolerance of the running mean of that line's middles. The fold runs per page, over that page's words only."""
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    page = words.where("text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "y0", "x1", "y1", "text"))).alias("_w"), F.median(height).alias("_h")
    )
    tolerance = F.greatest(F.lit(LEAST_LINE), F.col("_h") * LINE_SHARE)
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("lines"))

    def step(state: Column, w: Column) -> Column:
        joins = (state["n"] > 0) & (F.abs(w["cy"] - state["sum"] / F.greatest(state["n"], F.lit(1))) <= tolerance)
        number = F.when(joins, state["line"]).otherwise(state["line"] + 1)
        return F.struct(
            number.alias("line"), (F.when(joins, state["sum"]).otherwise(0.0) + w["cy"]).alias("sum"),
            (F.when(joins, state["n"]).otherwise(0) + 1).alias("n"), F.concat(state["lines"], F.array(number)).alias("lines"),
        )

    folded = page.select(*keys, "_w", F.aggregate("_w", start, step, lambda s: s["lines"]).alias("_l"))
    return folded.select(*keys, F.explode(F.arrays_zip("_l", "_w")).alias("z")).select(*keys, F.col("z._l").alias("line"), "z._w.x0", "z._w.y0", "z._w.x1", "z._w.y1", "z._w.text")


def segments(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, x0, x1, text) of the words of lines (keys name a line): cut at wide gaps."""
    order = Window.partitionBy(*keys).orderBy("x0", "x1", "text")
    line = words.groupBy(*keys).agg(F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).alias("_h"))
    gap = F.col("x0") - F.lag("x1").over(order)
    cut = words.join(line, keys).withColumn("_new", F.coalesce((gap > F.greatest(F.lit(LEAST_GAP), F.col("_h") * GAP)).cast("int"), F.lit(0)))
    numbered = cut.withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "segment").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ").alias("text")
    )


def table_cells(segs: DataFrame, page: list[str], line: str, least_columns: int = 3, least_rows: int = 2) -> DataFrame:
    """(page, row, col, text): lines of enough segments are the rows of one table, if there are enough of them."""
    wide = segs.groupBy(*page, line).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_columns)
    wide = wide.withColumn("row", F.dense_rank().over(Window.partitionBy(*page).orderBy(line)) - 1)
    enough = wide.groupBy(*page).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least_rows)
    return segs.join(wide, [*page, line]).join(enough, page, "left_semi").select(*page, "row", F.col("segment").alias("col"), "text")


def layout_line(segs: Column, left: Column) -> Column:
    """Segments (x0, text) in their columns of fixed width, at least a space apart."""

    def place(text: Column, s: Column) -> Column:
        column = F.bround((s["x0"] - left) / COLUMN).cast("int")
        room = F.greatest(F.when(F.length(text) > 0, F.lit(1)).otherwise(F.lit(0)), column - F.length(text))
        return F.concat(text, F.repeat(F.lit(" "), room), s["text"])

    return F.rtrim(F.aggregate(F.array_sort(segs), F.lit(""), place))


def centroid(points: Column) -> Column:
    """(x, y), the mean point; (0, 0) without any."""
    n = F.greatest(F.size(points), F.lit(1))
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[name]) / n
    return F.struct(F.coalesce(mean("x"), F.lit(0.0)).alias("x"), F.coalesce(mean("y"), F.lit(0.0)).alias("y"))


def polygon(box: Column) -> Column:
    """Four numbers as the corners of their rectangle, clockwise from the top left."""
    corner = lambda i, j: F.struct(F.get(box, i).alias("x"), F.get(box, j).alias("y"))
    return F.when(F.size(box) == 4, F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3)))


def affine(points: Column, t: Column) -> Column:
    """Points by a row-major 2 x 3 matrix."""
    return F.transform(
        points,
        lambda p: F.struct((t[0] * p["x"] + t[1] * p["y"] + t[2]).alias("x"), (t[3] * p["x"] + t[4] * p["y"] + t[5]).alias("y")),
    )


def reading_order(blocks: DataFrame, page: list[str], order: str, y: str, x: str, pos: str) -> DataFrame:
    """``blocks`` with ``rank`` from 0: by the engine's order, those without one last, then from the top left."""
    known = F.when(F.col(order) >= 0, F.col(order)).otherwise(UNORDERED)
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy(known, y, x, pos)) - 1)


def page_confidence(score: Column, box_mean: Column, block_mean: Column, text_share: Column, has_table: Column, cap: float = 0.9, base: float = 0.55, weight: float = 0.35, bonus: float = 0.05) -> Column:
    """The first that is not zero: the page's score, the mean of the boxes, that of the blocks, a guess from its text."""
    guess = F.when(text_share > 0, F.least(F.lit(cap), F.lit(base) + text_share * weight + F.when(has_table, bonus).otherwise(0.0)))
    return F.coalesce(F.nullif(score, F.lit(0.0)), F.nullif(box_mean, F.lit(0.0)), F.nullif(block_mean, F.lit(0.0)), guess, F.lit(0.0))


def positive_mean(c: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def display_order(blocks: DataFrame, page: str, order: Column, block_id: str, pos: str) -> DataFrame:
    """Blocks by page, then by their place in the page's reading order, those that it lacks last."""
    place = F.array_position(order, F.col(block_id))
    return blocks.withColumn("_place", F.when(place > 0, place).otherwise(UNORDERED)).orderBy(page, "_place", pos).drop("_place")
