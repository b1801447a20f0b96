"""Text that was decoded with the wrong character encoding.

Words with characters beyond ASCII are judged once each. A word's characters are mapped back to the bytes of a legacy
code page; an automaton over the structure of multibyte characters finds the maximal well-formed spans, and only these
are decoded, again and again while that goes on. A span counts if what it decodes to is ordinary writing and the word
gets more regular. Words that were written in one single-byte code and read in another have no such structure; they
count if the other reading is a far more frequent word of the same corpus. The replacement character always counts.

Defined results: null and empty texts are no cases; a garbled word that cannot be told apart (lost characters) is a
case whose text stays as it is; spans of ASCII are never touched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.legacy import TCVN3, VIETNAMESE
from foliant.tables import cut, looked_up

#: Code pages that texts are wrongly read in. Fixed values.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp1254", "cp1258", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "mac_cyrillic")
#: Single-byte codes that texts were written in, and those they were read in. Fixed values.
WRITTEN_IN = ("cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "iso8859_5", "cp850", "cp1258", "cp1250", "tcvn3", "vni")
SINGLE_READ_AS = ("cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "cp1250")
#: VNI: marks that follow a vowel, as read in Latin-1. Fixed values.
VNI_MARKS = {"ø": "̀", "ù": "́", "û": "̉", "õ": "̃", "ï": "̣"}
VNI_HATS = {"â": ("̂", ""), "à": ("̂", "̀"), "á": ("̂", "́"), "å": ("̂", "̉"), "ã": ("̂", "̃"), "ä": ("̂", "̣"), "ê": ("̆", ""), "è": ("̆", "̀"), "é": ("̆", "́"), "ú": ("̆", "̉"), "ü": ("̆", "̃"), "ë": ("̆", "̣")}
VNI_LETTERS = {"ñ": "đ", "Ñ": "Đ", "ö": "ư", "Ö": "Ư", "ô": "ơ", "Ô": "Ơ", "ó": "ĩ", "Ó": "Ĩ", "æ": "ỉ", "Æ": "Ỉ", "ò": "ị", "Ò": "Ị", "î": "ỵ", "Î": "Ỵ"}
#: Times that the other reading of a word must be more frequent, and the least frequency that tells anything.
MORE_FREQUENT, LEAST_FREQUENT = 4, 5

#: Characters that only a wrong decoding leaves behind: the replacement character and the controls of Latin-1.
LOST = regex.compile("[\uFFFD\x80-\x9F]")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: Characters that writing in the corpus's scripts is made of; a decoded span must consist of them.
ORDINARY = regex.compile(
    r"[\x20-\x7e\x80-ſƒƠơƯừ-̛̣̃̆̉Ά-ώЁЄІЇ"
    r"А-яёєіїҐґẠ-ỹ -―‘-„†-•… ‰′″"
    r"‹› ⁠€№™Ω　-ヿ㐀-鿿가-힣﻿]+"
)


@lru_cache
def _bytes_of(charset: str) -> dict[str, int]:
    """Character to byte; bytes that the code page leaves open stay what they are in Latin-1."""
    table: dict[str, int] = {}
    for byte in range(128, 256):
        try:
            char = bytes([byte]).decode(charset)
        except UnicodeDecodeError:
            char = chr(byte)
        table.setdefault(char, byte)
    if charset == "cp1252":  # Latin-1 as well
        for byte in range(128, 160):
            table.setdefault(chr(byte), byte)
    return table


@lru_cache
def _automaton(charset: str) -> regex.Pattern:
    """The structure of multibyte characters, over characters of the code page: a run of lead bytes, each with as
    many continuation bytes as it asks for."""
    table = _bytes_of(charset)

    def of(first: int, last: int) -> str:
        return "[" + "".join(regex.escape(c, special_only=False) for c, b in table.items() if first <= b <= last) + "]"

    more = of(0x80, 0xBF)
    return regex.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+")


def _script(char: str) -> str:
    if not char.isalpha():
        return ""
    code = ord(char)
    return "L" if code < 0x250 or 0x1E00 <= code < 0x1F00 else "G" if 0x370 <= code < 0x400 else "C" if 0x400 <= code < 0x530 else "O"


def changes(word: str) -> int:
    """Changes of script, and from lower to upper case, within the runs of letters of a word."""
    count, script, lower = 0, "", False
    for char in word:
        kind = _script(char)
        if kind:
            count += (bool(script) and kind != script) + (lower and char.isupper())
            script = kind
        lower = bool(kind) and char.islower()
    return count


def irregularity(word: str) -> int:
    """How unlike ordinary writing a word looks: changes of script and of case within it, and odd characters."""
    cost = 2 * changes(word)
    for char in word:
        if ord(char) > 127 and not _script(char):
            category = unicodedata.category(char)
            odd = category in ("Cc", "Co", "Cn", "So") or "─" <= char <= "▟"
            cost += 1 if char in "№©®°" else 3 if odd else 2 if category in ("Sm", "Sk", "Sc", "No", "Lm", "Mn", "Cf") else 1
    return cost


def decode_spans(word: str, charset: str) -> str:
    """``word`` with the maximal well-formed multibyte spans decoded, where they decode to ordinary writing."""
    table = _bytes_of(charset)

    def decoded(match: regex.Match) -> str:
        try:
            text = bytes(table[c] for c in match.group()).decode("utf-8")
        except UnicodeDecodeError:
            return match.group()
        return text if ORDINARY.fullmatch(text) else match.group()

    return _automaton(charset).sub(decoded, word)


def repair_multibyte(word: str) -> str | None:
    """The word first written, or None if nothing in it was multibyte."""
    given = word
    while True:  # a text may have been read wrongly several times; each round lowers the cost, or the length at equal cost
        best, least = word, irregularity(word)
        plain = changes("".join(c for c in word if c < "\x80"))
        for charset in READ_AS:
            other = decode_spans(word, charset)
            if other == word or changes(other) > plain:
                continue
            cost = irregularity(other)
            # Of equally regular words the shorter one wins if a lead byte or a longer sequence shows.
            if cost < least or (cost == least and (len(other) < len(best) and "Â" in word or len(other) < len(best) - 1)):
                best, least = other, cost
        if best == word:
            break
        word = best
    return word if word != given else None


@lru_cache
def _swap(read: str, written: str) -> dict[int, str]:
    out: dict[int, str] = {}
    if written == "tcvn3":
        return {ord(a): b for a, b in zip(TCVN3, VIETNAMESE)}
    for char, byte in _bytes_of(read).items():
        try:
            out[ord(char)] = bytes([byte]).decode(written)
        except UnicodeDecodeError:
            out[ord(char)] = "�"
    return out


def _from_vni(word: str) -> str:
    out: list[str] = []
    for at, char in enumerate(word):
        low = char.lower()
        before = unicodedata.normalize("NFD", out[-1])[0].lower() if out else ""
        if before and before in "aeiouy" + "ươ" and low in VNI_MARKS:
            out.append(VNI_MARKS[low])
        elif before in ("a", "e", "o") and low in VNI_HATS and not (out and unicodedata.combining(out[-1])):
            out.append("".join(VNI_HATS[low]))
        else:
            out.append(VNI_LETTERS.get(char, char))
    return unicodedata.normalize("NFC", "".join(out))


def single_byte_readings(word: str) -> list[str]:
    """What the word is if it was written in one single-byte code and read in another."""
    found = []
    for written in WRITTEN_IN:
        if written == "vni":
            found.append(_from_vni(word))
            continue
        for read in SINGLE_READ_AS if written != "tcvn3" else ("cp1252",):
            if read != written:
                found.append(word.translate(_swap(read, written)))
    # Đ and Ð are look-alikes rather than readings of one byte.
    same = word.translate(_ETH)
    return [w for w in dict.fromkeys(found) if w.translate(_ETH) != same and "�" not in w and not any(unicodedata.category(c) == "Cc" for c in w)]


_ETH = str.maketrans("ÐðĐđ", "DdDd")


def core_of(word: str) -> str:
    """The word without what stands around its letters, in lower case: what frequencies are counted of."""
    word = unicodedata.normalize("NFC", word)
    return word.strip("()[]{}<>.,;:!?\"'«»“”„…*#|/\\-–=_0123456789").lower()


def words_beyond_ascii(text: Column) -> Column:
    """The distinct words with a character beyond ASCII: those that have more bytes than code points."""
    return F.filter(F.array_distinct(F.split(text, r"[ \t\r\n]+")), lambda w: F.octet_length(w) > F.length(w))


def garbled_words(words: DataFrame) -> DataFrame:
    """(word, restored) of the garbled among the distinct words of (word, n); ``restored`` is null where it cannot
    be told. Works on distinct words only and joins them with their own frequencies."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for word, n in zip(frame.word, frame.n):
                fixed = repair_multibyte(word)
                if fixed is not None:
                    rows.append((word, n, "structure", fixed, None))
                    continue
                if LOST.search(word):
                    rows.append((word, n, "lost", None, None))
                rows.append((word, n, "self", None, core_of(word)))
                core = core_of(word)
                if sum(map(str.isalpha, core)) >= 2 or len(core) >= 3:
                    rows += [(word, n, "reading", other, core_of(other)) for other in single_byte_readings(word) if len(core_of(other)) >= 2 and LETTERS.search(core_of(other))]
            yield pd.DataFrame(rows, columns=["word", "n", "how", "restored", "core"])

    # Few bytes but much work: spread over all cores before, and written once, as four branches read it.
    # By another hash than that of the count, else its few partitions would do.
    spread = words.repartition(words.sparkSession.sparkContext.defaultParallelism * 2, F.xxhash64("word"))
    read_words = cut(spread.mapInPandas(read, "word string, n bigint, how string, restored string, core string"))
    sure = read_words.where("how in ('structure', 'lost')").select("word", "restored")
    frequent = read_words.where("how = 'self'").groupBy("core").agg(F.sum("n").alias("frequency"))
    own = read_words.where("how = 'self'").join(frequent, "core").select("word", F.col("frequency").alias("own"))
    other = read_words.where("how = 'reading'").join(frequent.where(F.col("frequency") >= LEAST_FREQUENT), "core").select("word", "restored", "frequency")
    best = other.groupBy("word").agg(F.max_by("restored", F.struct("frequency", "restored")).alias("restored"), F.max("frequency").alias("frequency"))
    likely = best.join(own, "word").where(F.col("frequency") >= MORE_FREQUENT * F.col("own")).select("word", "restored")
    return sure.unionByName(likely).groupBy("word").agg(F.max("restored").alias("restored"))


def find_garbled(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word, restored): the garbled words of each text. ``keys`` name a text; repeated rows count once in what
    comes out, though each counts for the words' frequencies."""
    beyond = texts.where(F.octet_length(text) > F.length(text))
    held = beyond.select(*keys, F.explode(words_beyond_ascii(F.col(text))).alias("word"))
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return looked_up(held, cut(garbled_words(counts)), "word").select(*keys, "word", "restored").distinct()


def restore(texts: DataFrame, keys: list[str], text: str, garbled: DataFrame) -> DataFrame:
    """(keys, text) of the texts with garbled words, those replaced by what was first written where it can be told."""
    replaced = garbled.where("restored is not null").groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("word", "restored"))).alias("_to"))
    cases = garbled.select(*keys).distinct().join(replaced, keys, "left")
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\r\n]+|[ \t\r\n]+"), F.lit(0))
    restored = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at("_to", w), w)), "")
    return texts.dropDuplicates(keys).join(cases, keys).select(*keys, F.coalesce(restored, F.col(text)).alias(text))
