"""Sentences: splitting, normal form, prose filter, split assignment."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmend.functions.letters import az_lower

# Abbreviations whose dot does not end a sentence.
ABBREVIATIONS = ("akad", "b", "c", "d", "dos", "e", "əsr", "hək", "ing", "məs", "mln", "mlrd", "prof", "red", "s", "sm", "təq", "y", "yun")
# The letters that prose may have, its signs of markup, and its bounds.
AZ_LETTERS = "abcçdeəfgğhxıijkqlmnoöprsştuüvyzABCÇDEƏFGĞHXIİJKQLMNOÖPRSŞTUÜVYZ"
ASCII_LETTERS = "a-zA-Z"
MARKUP = r"[|={}\[\]<>]"
LEAST_CHARS, MOST_CHARS, LEAST_WORDS, LEAST_LETTERS = 20, 300, 4, 0.6
#: Letters from which a text without the commonest marked letter is taken for another language.
LETTERS_FOR_LACK = 25
# Where a text is cut, and the word before a dot.
BOUNDARY = r"(?<=[.!?…])[ \t]+|\n+"
LAST_WORD = r"([^\s.]+)\.\s*$"

SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


#: The characters of SPACE.
BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LONGEST = max(map(len, ABBREVIATIONS))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize(c: Column) -> Column:
    """Collapsed white space and Unicode NFC; only texts with a character that NFC can change (U+0300 on) leave the JVM."""
    flat = collapse(c)
    return F.coalesce(_nfc(F.when(flat.rlike(r"[^\x{0}-\x{2ff}]"), flat)), flat)


def ends_with_abbreviation(piece: Column) -> Column:
    word = F.regexp_extract(piece, LAST_WORD, 1)
    return (word != "") & ((F.length(word) <= 1) | F.lower(word).isin(*ABBREVIATIONS))


def _abbreviated(piece: Column) -> Column:
    """``ends_with_abbreviation`` of a trimmed piece that ends with a dot: only its last few characters are looked at."""
    tail = F.substring(piece, -LONGEST - 3, LONGEST + 3)
    return tail.rlike(r"(?:^|[\s.])[^\s.]\.$") | F.lower(tail).rlike(rf"(?:^|[\s.])(?:{'|'.join(ABBREVIATIONS)})\.$")


def sentences(texts: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, sent_pos, sentence: pieces between sentence ends or line ends, glued after abbreviations.

    A piece has no line end, so pieces are joined by one, or by a blank after an abbreviation, and cut again: all
    happens inside the text.
    """
    cut = F.transform(F.split(F.col(text_col), BOUNDARY), lambda x: F.btrim(x, F.lit(BLANKS)))
    glued = F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.concat(x, F.when(x.endswith(".") & _abbreviated(x), " ").otherwise("\n")))
    rows = texts.select(F.col(id_col), F.posexplode(F.split(F.array_join(glued, ""), "\n")).alias("sent_pos", "sentence"))
    # A piece ends with no blank, so one at the end is that of a last abbreviation.
    return rows.where("sentence <> ''").select(id_col, F.col("sent_pos").cast("long").alias("sent_pos"), F.rtrim("sentence").alias("sentence"))


def is_usable(s: Column) -> Column:
    """Length, words, markup, first letter, share of letters and alphabet are within the bounds of prose."""
    # Nothing is taken out letter by letter: the words are met by one search, and the letters are what other signs leave.
    blank, sign = SPACE[1:-2], f"[^{SPACE[1:-2]}]++"
    return (
        F.length(s).between(LEAST_CHARS, MOST_CHARS)
        & s.rlike(f"{sign}(?:[{blank}]++{sign}){{{LEAST_WORDS - 1}}}")
        & ~s.rlike(MARKUP)
        & s.rlike(r"^\p{L}")
        & ~s.rlike(rf"[\p{{L}}&&[^{AZ_LETTERS}{ASCII_LETTERS}]]")
        & (F.length(F.regexp_replace(s, r"\P{L}+", "")) / F.length(s) >= LEAST_LETTERS)
    )


def bucket_of(name: Column) -> Column:
    """Stable bucket 0 to 99: the first byte of SHA-1, modulo 100."""
    return (F.conv(F.substring(F.sha1(name.cast("binary")), 1, 2), 16, 10).cast("int") % 100).cast("int")


def split_name(name: Column, dev: int = 5, test: int = 10) -> Column:
    """dev below ``dev``, test below ``test``, else train; (10, 20) for web documents."""
    b = bucket_of(name)
    return F.when(b < dev, "dev").when(b < test, "test").otherwise("train")


def lacks_letter(s: Column, letter: str = "ə") -> Column:
    return (F.regexp_count(s, F.lit(r"\p{L}")) >= LETTERS_FOR_LACK) & ~az_lower(s).contains(letter)
