import random
import unicodedata

from pyspark.sql import functions as F

from foliant.llm import encodings, lookalikes, scans
from foliant.tables import cut


def garbled(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = encodings.find_garbled(df, ["id"], "t")
    return {r.id for r in found.collect()}, {r.id: r.t for r in encodings.restore(df, ["id"], "t", found).collect()}


def test_multibyte_round_trips():
    for text in ("qualité", "Größe", "của", "счёт", "“bridge”", "m²", "€350", "Señor"):
        for code in ("cp1252", "mac_roman", "cp437", "cp1250"):
            try:
                read = text.encode().decode(code)
            except UnicodeDecodeError:
                continue
            assert encodings.repair_multibyte(read) == text, (text, code, read)
    assert encodings.repair_multibyte("việc".encode().decode("latin-1").encode().decode("latin-1")) == "việc"
    for plain in ("HÀNG", "MÃ", "São", "AÇÃO", "naïve", "склад", "Ω", "½", "«témoin»", "ß", "MÃ HÀNG", ""):
        assert encodings.repair_multibyte(plain) is None, plain


def test_garbled_texts(spark):
    clean = ["hóa đơn của hàng được giao", "счёт на склад контейнера"] * 30
    texts = clean + ["hµng cña ®­îc", "ñ÷¸ò ñêëàä", "УЮЈФ", "Modalit�s", None, "", "qualitÃ©\n x", "hàng bộ"]
    ids, restored = garbled(spark, texts)
    n = len(clean)
    assert ids >= {n, n + 1, n + 3, n + 6} and not ids & (set(range(n)) | {n + 4, n + 5, n + 7})
    assert restored[n + 6] == "qualité\n x" and restored[n + 1].endswith("склад") and restored[n + 3] == "Modalit�s"
    assert garbled(spark, []) == (set(), {})


def unified(spark, rows):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "id int, t string, is_code boolean")
    found = lookalikes.find_lookalikes(df, ["id"], "t", "is_code")
    return {r.id: r.t for r in lookalikes.unify(df, ["id"], "t", "is_code", found).collect()}


def test_lookalikes(spark):
    cases = [
        ("ｔｏｇｅｔｈｅｒ now", "together now"), ("réglé", "réglé"), ("co​ntract", "contract"), ("the order", "the order"),
        ("buуer", "buyer"), ("pядoм", "рядом"), ("non‑refundable", "non-refundable"), ("conﬁrm", "confirm"), ("Ⅽonsignes", "Consignes"), ("bộ", "bộ"),
        ("The саѕе of it", "The case of it"), ("Ðại lý", "Đại lý"),
    ]
    kept = ["plain text", "“typographic” – dash’s", "12 m² ½ № 7 5 µm Ω", "шайба и муфта", "class Ω αβγ", "納品書、注文", "été HÀNG", "", None, "счёт с учётом"]
    codes = [("ВR960-3745", "BR960-3745"), ("ＳＲ１３５－０８３９", "SR135-0839"), ("PO‐123", "PO-123"), ("﻿CT-1", "CT-1")]
    rows = [(a, False) for a, _ in cases] + [(k, False) for k in kept] + [(a, True) for a, _ in codes] + [("SR135-0839", True)]
    out = unified(spark, rows)
    for i, (_, want) in enumerate(cases):
        assert out[i] == unicodedata.normalize("NFC", want)
    assert not set(out) & set(range(len(cases), len(cases) + len(kept)))
    assert [out[len(cases) + len(kept) + i] for i in range(len(codes))] == [w for _, w in codes] and len(rows) - 1 not in out


def test_forms_equal_unicode(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeouABzđ") + "".join(rng.sample("̛̣̀́̂̃̈", rng.randint(0, 3))) for _ in range(6)) for _ in range(60)]
    words = spark.createDataFrame([(t, False) for t in dict.fromkeys(texts)], "word string, is_code boolean")
    for r in lookalikes.forms(words).collect():
        assert r.form == unicodedata.normalize("NFC", r.word)


KEYS = ["src", "rec_id"]


def noise(spark, texts, numbers=()):
    """Each text a block on a page of its own; those of CLEAN are of other requests than the rest."""
    rows = [("block", i, t, f"c{i}" if t in CLEAN else "r", i, None, 0, i in numbers) for i, t in enumerate(texts) if t]
    df = spark.createDataFrame(rows, "src string, rec_id bigint, text string, request_id string, page int, pages int, pos int, is_number boolean")
    read = cut(scans.read_texts(df), by="part")
    tokens = cut(read.where("part = 'token'").groupBy("token").agg(F.sum("n").alias("n")))
    words = cut(scans.vocabulary(tokens))
    return df, scans.find_cuts(read.where("part = 'end'"), words), scans.find_misread(df, tokens, words), scans.find_furniture(read)


def ids(df):
    return {r.rec_id for r in df.collect()}


def repaired(spark, texts, numbers=()):
    df, cuts, misreads, furniture = noise(spark, texts, numbers)
    return {r.rec_id: r.text for r in scans.repair(df.select(*KEYS, "text"), KEYS, "text", cuts, misreads, furniture).collect()}


CLEAN = ["the container is settled before the long-term delivery of the tax-free goods under contract"] * 60


def test_scan_noise(spark):
    n = len(CLEAN)
    texts = CLEAN + ["the con-\ntainer is here", "the tax-\nfree goods", "the con¬ \ntainer", "the c0ntainer and deliverv", "the settlcd contract", "amount 13963Z6.43 due", "Page 3", "[Page 3]", None, "", "Copy for Mills (1)\nfirst of all", "Copy for Mills (2)\nthen more", "Copy for Mi1ls (3)\nat last"]
    df, cuts, misreads, furniture = noise(spark, texts)
    assert ids(cuts) == {n, n + 2}
    found = {i - n for i in ids(misreads)}
    assert found >= {3, 4, 5} and not found & ({*range(-n, 3)})
    assert {6, 10, 11, 12} <= {i - n for i in ids(furniture)}
    fixed = {r.rec_id - n: r.text for r in scans.repair(df.select(*KEYS, "text"), KEYS, "text", cuts, misreads, furniture).collect()}
    assert fixed[0] == "the container is here" and fixed[2] == "the container" and fixed[4] == "the settled contract" and fixed[10] == "first of all" and fixed[6] == ""


def test_repair_keeps_case_and_what_stands_around(spark):
    n = len(CLEAN)
    fixed = repaired(spark, CLEAN + ["THE C0NTAINER", "the 'settlcd' one", "Settlcd (c0ntainer),", "a con-\n   tainer and a long-\n  term one", "con-\ntents of the con-\ntainer"])
    assert [fixed.get(n + i) for i in range(4)] == ["THE CONTAINER", "the 'settled' one", "Settled (container),", "a container and a long-term one"]
    assert "con-" not in fixed[n + 4].replace("con-tents", "")


def test_long_words_and_furniture_of_any_length(spark):
    n, word, head = len(CLEAN), "abcdefghij" * 30, "Notes for the carrier of " + "Mills " * 30
    texts = CLEAN + [f"an {word} here"] * 20 + [f"an {word[:8]}1{word[9:]} here"]
    texts += [f"{head}\nfirst text of the page", f"{head}\nsecond text of the page", f"{head}\nthird text of the page", "—" * 40 + " 12 " + "—" * 40]
    _, _, misreads, furniture = noise(spark, texts)
    assert n + 20 in ids(misreads) and {n + 21, n + 22, n + 23, n + 24} <= ids(furniture)


def test_misread_by_shuffle_equals_broadcast(spark, monkeypatch):
    texts = CLEAN + ["the c0ntainer and settlcd", "S", "8S.40"] * 3
    by_broadcast = set(noise(spark, texts, numbers={61, 62})[2].collect())
    monkeypatch.setattr(scans, "BROADCAST_BYTES", 0)
    assert set(noise(spark, texts, numbers={61, 62})[2].collect()) == by_broadcast and by_broadcast


def test_ranker_on_held_out_words():
    rng = random.Random(3)
    vocabulary = [("".join(rng.choice("abcdefghilmnorstuvw") for _ in range(rng.randint(5, 11))), 500) for _ in range(400)]
    model = scans.fit_ranker(vocabulary[:300])
    right = total = 0
    for word, _ in vocabulary[300:]:
        read = scans.misread(word, rng)
        if read and read != word:
            frame = scans.pd.DataFrame([(read, word, 5, 500), (read, vocabulary[0][0], 5, 500)], columns=["word", "candidate", "n", "m"])
            good, bad = model.probability(scans._features(frame))
            total += 1
            right += good > 0.5 > bad
    assert total > 60 and right / total > 0.9


def test_noise_of_nothing(spark):
    df, cuts, misreads, furniture = noise(spark, [None, ""])
    assert cuts.count() == misreads.count() == furniture.count() == df.count() == 0


def test_texts_of_p4_are_left_by_p3(spark, tmp_path):
    garbled_text = "квалité de ｔest " + "của hàng được giao".encode().decode("latin-1")
    rows = [(1, garbled_text), (2, "ｔｏｇｅｔｈｅｒ now")]
    spark.createDataFrame(rows, "block_no long, content string").write.parquet(f"{tmp_path}/blocks.parquet")
    spark.createDataFrame([], "extraction_id long, markdown string").write.parquet(f"{tmp_path}/extractions.parquet")
    spark.createDataFrame([], "cell_no long, text string, col_idx int, row_idx int").write.parquet(f"{tmp_path}/table_cells.parquet")
    spark.createDataFrame([], "item_id long, customer_number string").write.parquet(f"{tmp_path}/extraction_items.parquet")
    from foliant.llm import lookalikes_queries

    assert [(r.rec_id, r.text) for r in lookalikes_queries.p3_unified(spark, str(tmp_path)).collect()] == [(2, "together now")]
