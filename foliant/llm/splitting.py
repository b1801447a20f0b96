"""Splitting of oversized texts at natural boundaries.

A text of more than ``max_chars`` code points is cut into cores by one regular expression with bounded quantifiers:
its alternatives, in the order of the boundary's strength (paragraph, line, sentence, word), consume as much as fits
and the last one, any characters, always fits. Each piece is a core with the ``overlap`` code points before it, so it
has at most ``max_chars`` code points, and all pieces without their overlaps give the text again.

Defined results: null and empty texts have no pieces; a text within the limit is one piece; a limit of null leaves the
text whole; ``overlap`` is taken as at least 0 and less than ``max_chars``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before a cut, the strongest boundary first, and the least share of the room that a core must fill to end there.
BOUNDARIES = (
    (r"(?<=\n[ \t]{0,8}\r?\n)", 0.5),
    (r"(?<=\n)", 0.5),
    (r"(?<=[.!?;:…。][\s ])", 0.5),
    (r"(?<=\s)", 0.0),
    (r"(?!\p{M})", 0.0),
)


def core_pattern(room: Column) -> Column:
    """The pattern that takes one core of at most ``room`` code points."""
    parts: list[Column] = [F.lit("(?s).{1,"), room.cast("string"), F.lit(r"}\z|")]  # the rest, if it fits
    for look, fill in BOUNDARIES:
        least = F.greatest(F.lit(1), (room * fill).cast("int")).cast("string")
        parts += [F.lit(".{"), least, F.lit(","), room.cast("string"), F.lit("}" + look + "|")]
    return F.concat(*parts, F.lit(".{1,"), room.cast("string"), F.lit("}"))


def split_pieces(df: DataFrame, id_cols: list[str], text: str, max_chars: Column, overlap: Column) -> DataFrame:
    """(id_cols, piece_no, piece_count, start, piece): ``start`` is where the piece begins in the text, from 0."""
    most = max_chars.cast("int")
    shared = F.least(F.greatest(F.coalesce(overlap.cast("int"), F.lit(0)), F.lit(0)), most - 1)
    cores = F.when(F.length("_text") <= F.coalesce("_most", F.length("_text")), F.array("_text")).otherwise(
        F.regexp_extract_all("_text", core_pattern(F.col("_most") - F.col("_shared")), F.lit(0))
    )
    texts = df.select(*id_cols, F.col(text).alias("_text"), most.alias("_most"), shared.alias("_shared")).where(F.length("_text") > 0)
    texts = texts.select(*id_cols, "_text", "_shared", cores.alias("_cores"))
    ends = F.aggregate(
        F.transform("_cores", F.length),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    texts = texts.select(*id_cols, "_text", "_shared", F.size("_cores").alias("piece_count"), ends.alias("_ends"))
    flat = texts.select(*id_cols, "_text", "_shared", "piece_count", "_ends", F.explode(F.sequence(F.lit(0), F.col("piece_count") - 1)).alias("piece_no"))
    start = F.greatest(F.lit(0), F.get("_ends", F.col("piece_no")) - F.when(F.col("piece_no") > 0, F.col("_shared")).otherwise(0))
    flat = flat.select(*id_cols, "piece_no", "piece_count", "_text", start.alias("start"), F.get("_ends", F.col("piece_no") + 1).alias("_end"))
    return flat.select(*id_cols, "piece_no", "piece_count", "start", F.substring("_text", F.col("start") + 1, F.col("_end") - F.col("start")).alias("piece"))
