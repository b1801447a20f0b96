"""Byte-level BPE encoding and decoding of a corpus with a public vocabulary.

A text is cut into words (a run of non-spaces with the space before it, or white space), a word into the tokenizer's
pre-tokens, and a pre-token's bytes are folded by ranked merges: each step merges the first pair of the lowest rank and
looks up the ranks of the two pairs that it makes, until no pair has a rank.

Texts are encoded in one Arrow pass without a shuffle. NumPy cuts the bytes of many texts into words at once, Arrow
numbers the distinct ones, and only those are folded; their ids are then put where the words stand. A worker keeps the
ids of the words it met last, of bounded number and size, which saves folds and never changes ids. Decoding is a Spark
expression. The map of ``bucketed_map`` is an array of buckets by hash, because Spark looks a map's key up by scanning it.

Defined results: null and empty texts have the empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer's pattern within a word; letters first, which cannot change a match and saves attempts. Fixed values.
PRETOKENS = regex.compile(r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}++")
#: White space outside ASCII in UTF-8, the Unicode property: first byte, the others, as one number.
WIDE_SPACES = {0xC2: [0x85, 0xA0], 0xE1: [0x9A80], 0xE2: [*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F], 0xE3: [0x8080]}

HOT_BYTES = 64  # the ids of longer words are not kept
CHUNK_BYTES = 8 << 20  # about the most bytes of texts that are cut at once; a longer text is cut alone
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def vocabulary(path: str) -> dict[bytes, int]:
    """The rank of each token; its size is that of the file, here 50,256 tokens."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def ranks(spark: SparkSession, path: str = TOKENIZER_PATH) -> DataFrame:
    """(token, rank): the vocabulary."""
    held = vocabulary(path)
    return spark.createDataFrame(pa.table({"token": pa.array(held, pa.binary()), "rank": pa.array(held.values(), pa.int32())}))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


def bucketed_map(df: DataFrame, key: str, value: str, buckets: int) -> Column:
    """The rows of ``df`` as one value, an array with a map in each place; of bounded size by its caller's account."""
    rows = df.select(_bucket(F.col(key), buckets).alias("b"), F.struct(key, value).alias("e"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(None).alias("e"))
    maps = rows.unionByName(every).groupBy("b").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    held = maps.agg(F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"]).alias("held"))
    return held_literal(held.select(F.transform("held", lambda x: x["m"]).alias("held")))


def held_literal(one_value: DataFrame) -> Column:
    """The value of a DataFrame of one row and one column as a literal. It stays in Spark's own binary form, and the
    plan holds it once; functions.lit would make an expression of each element."""
    jvm = one_value.sparkSession._jvm
    row = one_value._jdf.queryExecution().executedPlan().executeCollect()[0]
    kind = one_value._jdf.schema().apply(0).dataType()
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.get(0, kind), kind)))


def look_up(held: Column, key: Column, buckets: int) -> Column:
    """The key's value, or null."""
    return F.try_element_at(F.get(held, _bucket(key, buckets)), key)


def word_starts(octets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the words of texts in UTF-8 begin that stand one after another; ``begins`` are the places of the texts.
    A word is what ``( ?\\S+|\\s+(?!\\S)|\\s+)`` finds: the last character of white space before a non-space belongs to
    the word that follows if it is a space, and else is a word of its own."""
    space = (octets == 32) | ((octets >= 9) & (octets <= 13))
    if (octets >= 0x80).any():
        _add_wide_spaces(octets, space)
    cut = np.zeros(len(octets), bool)
    cut[begins] = True
    after = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    after = after[~cut[after]]
    cut[1:] |= space[1:] & ~space[:-1]
    before = octets[after - 1]
    last = after - np.where(before < 0x80, 1, np.where(octets[after - 2] == 0xC2, 2, 3))
    cut[last] = True
    cut[after[before != 32]] = True
    return np.flatnonzero(cut)


def _add_wide_spaces(octets: np.ndarray, space: np.ndarray) -> None:
    for lead, rest in WIDE_SPACES.items():
        width = 2 if lead == 0xC2 else 3
        at = np.flatnonzero(octets[: len(octets) - width + 1] == lead)
        value = octets[at + 1].astype(int)
        at = at[np.isin(value if width == 2 else value << 8 | octets[at + 2], rest)]
        for i in range(width):
            space[at + i] = True


class Encoder:
    """Ids of words by ranked merges. Those of the words met last are kept, of twice ``kept`` words at most."""

    def __init__(self, ranked: dict[bytes, int], kept: int):
        self.ranked, self.kept = ranked, kept
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def word_ids(self, word: bytes) -> bytes:
        """The ids of a word as bytes of 32-bit numbers."""
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                pretokens = PRETOKENS.findall(word.decode("utf-8", "replace"))
                ids = array("i", [i for p in pretokens for i in self.fold(p.encode())]).tobytes()
            if len(word) <= HOT_BYTES:
                if len(self.young) >= self.kept:
                    self.young, self.old = {}, self.young
                self.young[word] = ids
        return ids

    def fold(self, octets: bytes) -> list[int]:
        """The ids of one pre-token. Pairs wait in a heap, so that time grows little faster than the length."""
        rank_of = self.ranked.get
        whole = rank_of(octets)
        if whole is not None:
            return [whole]
        size = len(octets)
        ends = list(range(1, size + 1))  # of the piece that begins here
        starts = list(range(-1, size))  # of the piece before the one that begins here
        pair: list[int | None] = [rank_of(octets[i : i + 2]) for i in range(size - 1)] + [None]  # rank of the piece here with the next
        waiting = [(rank, i) for i, rank in enumerate(pair) if rank is not None]
        heapify(waiting)
        while waiting:
            rank, at = heappop(waiting)
            if pair[at] != rank:
                continue  # one of the two was merged meanwhile
            gone = ends[at]
            end = ends[at] = ends[gone]
            pair[gone] = pair[at] = None
            if end < size:
                starts[end] = at
                pair[at] = new = rank_of(octets[at : ends[end]])
                if new is not None:
                    heappush(waiting, (new, at))
            if at:
                before = starts[at]
                pair[before] = new = rank_of(octets[before:end])
                if new is not None:
                    heappush(waiting, (new, before))
        ids, at = [], 0
        while at < size:
            ids.append(self.ranked[octets[at : ends[at]]])
            at = ends[at]
        return ids

    def texts_ids(self, texts: pa.Array) -> pa.Array:
        """The list of ids of each text; ``texts`` as large binary without nulls."""
        _, offsets, octets = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        first, size = int(at[0]), int(at[-1] - at[0])
        at = at - first
        if not size:
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        octets = octets.slice(first, size)
        starts = word_starts(np.frombuffer(octets, np.uint8), at[:-1][at[:-1] < at[1:]])
        places = pa.py_buffer(np.append(starts, size).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, places, octets]).dictionary_encode()
        ids = [self.word_ids(w) for w in words.dictionary.to_pylist()]
        counts = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
        every = pa.ListArray.from_arrays(counts, pa.array(np.frombuffer(b"".join(ids), np.int32))).take(words.indices)
        return pa.ListArray.from_arrays(every.offsets.take(pa.array(np.searchsorted(starts, at))), every.values)


def encode_batch(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, an id and a text, with the ids of the text, in runs of about ``CHUNK_BYTES`` of texts."""
    texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        most = (ends[at - 1] if at else 0) + CHUNK_BYTES
        to = max(at + 1, int(np.searchsorted(ends, most, "right")))
        yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], encoder.texts_ids(texts[at:to])], names=[batch.schema.names[0], "ids"])
        at = to


def encode(docs: DataFrame, id_col: str, text: str, hot_words: int = 131_072, path: str = TOKENIZER_PATH) -> DataFrame:
    """(id_col, ids): the ids of each row's text, without special tokens. ``hot_words`` bounds the words that are kept."""
    held = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary(path), hot_words))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held.value  # stays in the worker, with the words it keeps
        for batch in batches:
            yield from encode_batch(encoder, batch)

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, id_col: str, ids: str, path: str = TOKENIZER_PATH) -> DataFrame:
    """(id_col, text): the pieces of the ids, concatenated; an id outside the vocabulary makes the text null, as does
    a null list. Bytes that are no UTF-8 become replacement characters."""
    held = ranks(tokens.sparkSession, path).agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("v"))
    held = held_literal(held.select(F.transform("v", lambda e: e["token"]).alias("held")))
    pieces = F.transform(ids, lambda i: F.hex(F.get(held, i.cast("int"))))  # joined at once: appending would copy the text for each piece
    joined = F.when(~F.exists(pieces, lambda p: p.isNull()), F.unhex(F.array_join(pieces, "")))
    return tokens.select(id_col, F.decode(joined, "UTF-8").alias("text"))
