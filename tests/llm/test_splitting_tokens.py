import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import splitting, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def pieces(spark, text, most, shared):
    df = spark.createDataFrame([(1, text, most, shared)], "id int, t string, m int, s int")
    return splitting.split_pieces(df, ["id"], "t", F.col("m"), F.col("s")).orderBy("piece_no").collect()


@pytest.mark.parametrize(
    ("text", "most", "shared"),
    [("word " * 50, 40, 5), ("x" * 1000, 33, 10), ("para one.\n\npara two is longer.\n\n" * 9, 60, 0), ("é́😀" * 90, 20, 3), ("a b", 1, 5), ("Satz. " * 40 + "\r\n\r\n" + "y" * 90, 50, 49)],
)
def test_pieces_give_the_text_again(spark, text, most, shared):
    out = pieces(spark, text, most, shared)
    shared = min(shared, most - 1)
    whole = ""
    for i, p in enumerate(out):
        assert len(p.piece) <= most and text[p.start : p.start + len(p.piece)] == p.piece
        overlap = len(whole) - p.start
        assert overlap == (0 if i == 0 else min(shared, len(whole)))
        whole += p.piece[overlap:]
    assert whole == text and {p.piece_count for p in out} == {len(out)}


def test_boundaries_and_edges(spark):
    assert [p.piece for p in pieces(spark, "aaaa bbbb.\n\ncccc dddd", 15, 0)] == ["aaaa bbbb.\n\n", "cccc dddd"]
    assert pieces(spark, "", 5, 1) == [] and pieces(spark, None, 5, 1) == []
    assert [p.piece for p in pieces(spark, "short", 5, 1)] == ["short"]
    assert [p.piece for p in pieces(spark, "no limit", None, None)] == ["no limit"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=60, max_size=60))
def _random_texts(run, texts):
    run(texts)


def test_ids_and_round_trip(spark, reference):
    def run(extra):
        fixed = [None, "", "   ", " \n\n  a  b\t\tc ", "it's we'll 'sx", "naïve café Ünïcödé", "日本語のテキスト", "<|endoftext|> x", "█" * 300, "aaaaaaaaaaaaaaaaaaaaaaab", "a" * 500, "tab\tend ", " x　y", "12345678 9.99", "é"]
        texts = fixed + [t.encode("utf-8", "ignore").decode() for t in extra]
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        encoded = tokens.encode(df, "id", "t", hot_words=10)
        got = {r.id: r.ids for r in encoded.collect()}
        for i, t in enumerate(texts):
            assert got[i] == (reference.encode_ordinary(t) if t else []), repr(t)
        back = {r.id: r.text for r in tokens.decode(encoded, "id", "ids").collect()}
        assert all(back[i] == (t or "") for i, t in enumerate(texts))

    _random_texts(run)


def test_empty_corpus(spark):
    assert tokens.encode(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0
