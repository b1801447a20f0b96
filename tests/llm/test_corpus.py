import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import leaks, quality


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(20)]
    docs = []
    for d in range(60):
        body = [rng.choice(words + ["other", "thing"]) for _ in range(60)]
        if d % 3 == 0:
            take = rng.choice(items)[1].split()
            body[10:10] = take[: rng.randint(1, len(take))]
        docs.append((d, " ,\n".join(w.upper() if rng.random() < 0.3 else w for w in body)))
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1])]
    n = 6
    grams = lambda t: {tuple(x[i : i + n]) for x in [leaks.WORD.findall((t or "").casefold())] for i in range(len(x) - n + 1)}
    expected = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    df, tests = spark.createDataFrame(docs, "id int, item_id string"), spark.createDataFrame([*items, (99, None)], "h long, t string")
    found = leaks.find_leaks(df, "id", "item_id", tests, "h", "t", n)
    assert {(r.id, r.item_id) for r in found.collect()} == expected and expected
    cleaned = leaks.without_spans(df, "id", "item_id", found)
    assert leaks.find_leaks(cleaned.where("id <> 62"), "id", "item_id", tests, "h", "t", n).join(found, ["id", "item_id"], "left_anti").count() == 0
    assert leaks.find_leaks(df, "id", "item_id", tests.limit(0), "h", "t", n).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([(1, "Start: One two, three! four end.")], "id int, t string")
    tests = spark.createDataFrame([(7, "one TWO three four")], "h long, t string")
    r = leaks.find_leaks(df, "id", "t", tests, "h", "t", 3)
    assert [(x.start, x.end) for x in r.collect()] == [(7, 27)]
    assert leaks.without_spans(df, "id", "t", r).first().t == "Start:  end."


def test_spans_where_folding_changes_words(spark, monkeypatch):
    texts = ["İ start of it: one two three four, tail words", "İstanbul straße ONE TWO three four ǰ end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    tests = spark.createDataFrame([(7, "one TWO three four"), (8, "istanbul strasse one")], "h long, t string")
    r = leaks.find_leaks(df, "id", "t", tests, "h", "t", 3)
    assert {(x.id, x.item_id, texts[x.id][x.start : x.end]) for x in r.collect()} == {(0, 7, "one two three four"), (1, 7, "ONE TWO three four"), (1, 8, "İstanbul straße ONE")}
    assert {x.id: x.t for x in leaks.without_spans(df, "id", "t", r).collect()} == {0: "İ start of it: , tail words", 1: " ǰ end"}
    monkeypatch.setattr(leaks, "MAX_TEST_WORDS", 5)
    assert set(leaks.find_leaks(df, "id", "t", tests, "h", "t", 3).collect()) == set(r.collect())


def test_quality(spark):
    prose = ["The court held that the appeal was dismissed, and that the costs were not to be paid by the defendant. " * k for k in range(2, 40)]
    junk = ["| 1 | 2 |\n| 3 | 4 |\n" * 30, "x9 7f a1 b2\n" * 60, "Home Login Search Print " * 30]
    rows = [(i, t, "en") for i, t in enumerate(prose + junk)] + [(100, None, "en"), (101, "", None), (102, " \n", "en"), (103, prose[3], None), (104, "!!!", "xx")]
    out = {r.id: r for r in quality.judge(spark.createDataFrame(rows, "id int, t string, l string"), "id", "t", "l").collect()}
    assert not {100, 101, 102} & set(out)
    assert all(out[i].is_prose for i in range(len(prose))) and out[103].is_prose and out[103].language == "en"
    assert not any(out[len(prose) + i].is_prose for i in range(len(junk)))
    for r in out.values():
        assert np.isclose(r.distance, sum(r[f"contribution_{s}"] for s in quality.STATS), rtol=1e-6, atol=1e-6)
    assert quality.judge(spark.createDataFrame([], "id int, t string, l string"), "id", "t", "l").select(F.count("*")).first()[0] == 0
