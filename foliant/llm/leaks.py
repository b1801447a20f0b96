"""Evaluation passages that leak into a corpus.

The test items are normalised to words (runs of letters or digits, case folded). The set of their n-grams is broadcast:
it belongs to the fixed evaluation set, and beyond a size
its items are scanned for in several passes. Training texts are scanned window by window, each
window of ``n`` words is looked up, and a hit is verified against the words themselves, not only their numbers.

Defined results: a null or empty text has no hits; an item of fewer than ``n`` words has no n-grams and cannot be
found; repeated rows give the same hits again; ``start`` and ``end`` are code point offsets of a maximal leaked span.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: About the most words of test items that are held at once; more are scanned for in several passes.
MAX_TEST_WORDS = 1_000_000


def _recut() -> dict[int, str]:
    """Characters that folding would cut a word at or join words by, with what they are folded to instead."""
    out = {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        folded = char.casefold()
        if folded != char and bool(WORD.fullmatch(char)) != bool(WORD.fullmatch(folded)):
            out[code] = "".join(WORD.findall(folded)) if WORD.fullmatch(char) else " "
    return out


RECUT = _recut()
_RECUT_ANY = regex.compile("[" + "".join(map(chr, RECUT)) + "]")


def words_of(text: str) -> list[str]:
    """The words, case folded: as many as WORD finds in the text as given."""
    return WORD.findall((text.translate(RECUT) if _RECUT_ANY.search(text) else text).casefold())


class TestGrams:
    """The n-grams of all test items: words by number, and the items of each n-gram."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        self.n = n
        self.number: dict[str, int] = {}
        grams: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")]
            for at in range(len(numbers) - n + 1):
                grams[tuple(numbers[at : at + n])].add(item)
        self.grams = {g: tuple(sorted(found)) for g, found in grams.items()}

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first word, last word) of each maximal run of windows that hit."""
        lookup = self.number.get
        numbers = np.fromiter((lookup(w, 0) for w in words_of(text)), np.int64)
        return self._runs(numbers)

    def _runs(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        n = self.n
        if len(numbers) < n:
            return []
        # A window can only hit where n words in a row are words of test items.
        unknown = np.concatenate(([0], np.cumsum(numbers == 0)))
        windows = np.flatnonzero(unknown[n:] == unknown[:-n])
        found: dict[int, list[list[int]]] = defaultdict(list)
        for at in windows.tolist():
            for item in self.grams.get(tuple(numbers[at : at + n].tolist()), ()):
                runs = found[item]
                if runs and runs[-1][1] >= at + n - 2:
                    runs[-1][1] = at + n - 1
                else:
                    runs.append([at, at + n - 1])
        return [(item, first, last) for item, runs in sorted(found.items()) for first, last in runs]


def find_leaks(docs: DataFrame, id_col: str, text: str, items: DataFrame, item_col: str, item_text: str, n: int = 12) -> DataFrame:
    """(id_col, item_id, start, end): the maximal spans of at least ``n`` words that a text shares with an item."""
    words = items.agg(F.sum(F.length(item_text)) / 2).first()[0] or 0
    passes = int(words // MAX_TEST_WORDS) + 1
    share = F.pmod(F.xxhash64(item_col, item_text), F.lit(passes))
    found = [_scan(docs, id_col, text, [tuple(r) for r in items.where(share == k).select(item_col, item_text).collect()], n) for k in range(passes)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _scan(docs: DataFrame, id_col: str, text: str, items: list[tuple[int, str | None]], n: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(TestGrams(items, n))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for batch in batches:
            out: list[tuple] = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = grams.hits(content) if content else []
                if hits:
                    spans = [m.span() for m in WORD.finditer(content)]
                    out += [(doc, item, spans[a][0], spans[b][1]) for item, a, b in hits]
            columns = list(zip(*out)) or [(), (), (), ()]
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[id_col, "item_id", "start", "end"])

    return docs.select(id_col, text).mapInArrow(scan, f"`{id_col}` {kind}, item_id bigint, start int, end int")


def without_spans(docs: DataFrame, id_col: str, text: str, leaks: DataFrame) -> DataFrame:
    """``docs`` with the leaked spans cut out of ``text``; overlapping spans are cut once."""
    spans = leaks.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    kept = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    joined = docs.join(spans, id_col, "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns])
