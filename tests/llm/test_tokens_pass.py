import base64
import time

import pyarrow as pa
import pytest
import tiktoken

from foliant.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_corpus_is_read_once_and_not_while_the_query_is_built(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "id int, t string")
    spark.sparkContext.setJobGroup("building", "")
    try:
        encoded = tokens.encode(docs, "id", "t")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()


def test_time_of_a_long_word_is_no_square(spark, reference):
    text = "ab" * 10_000 + " " + "é" * 5_000
    began = time.time()
    row = tokens.encode(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").first()
    assert row.ids == reference.encode_ordinary(text)
    assert time.time() - began < 30


def test_each_word_is_folded_once_and_texts_stay_apart(reference):
    class Counting(tokens.Encoder):
        folds = 0

        def fold(self, octets):
            self.folds += 1
            return super().fold(octets)

    encoder = Counting(tokens.vocabulary(tokens.TOKENIZER_PATH), kept=100)
    texts = ["unseen qwzx" * 50, "", "qwzx ", " qwzx", "", "qwzx unseen", ""]
    for _ in range(3):
        ids = encoder.texts_ids(pa.array(texts).cast(pa.large_binary())).to_pylist()
        assert ids == [reference.encode_ordinary(t) for t in texts]
    assert encoder.folds == 6  # "unseen", " qwzxunseen", " qwzx", "qwzx", " ", " unseen"


def test_white_space_of_every_kind(reference):
    texts = [f"{pad}{a}{b}{word}{b}{a}{word}{a}" for a in SPACES for b in SPACES for pad in ("", "x") for word in ("w", "é", "'s", "\x1c")]
    for kept in (1, 100):
        encoder = tokens.Encoder(tokens.vocabulary(tokens.TOKENIZER_PATH), kept)
        assert encoder.texts_ids(pa.array(texts).cast(pa.large_binary())).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_batches_are_cut_by_their_bytes(reference, monkeypatch):
    texts = ["", "a b" * 40, None, "", "long " * 300, "c", None]
    kept = tokens.Encoder(tokens.vocabulary(tokens.TOKENIZER_PATH), 10)
    for most in (1, 100, 1000, 10_000):
        monkeypatch.setattr(tokens, "CHUNK_BYTES", most)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "t"])
        out = pa.Table.from_batches(tokens.encode_batch(kept, batch)).to_pydict()
        assert list(out.values()) == [list(range(len(texts))), [reference.encode_ordinary(t or "") for t in texts]]
