"""Scalar character functions of Azerbaijani text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven letter pairs, accented and plain, small and capital.
ACCENTED = "çəğıöşüÇƏĞİÖŞÜ"
PLAIN = "cegiosuCEGIOSU"


def az_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def az_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def strip_diacritics(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def mark(c: Column) -> Column:
    """The accented reading of foldable letters; others stay."""
    return F.translate(c, PLAIN, ACCENTED)


def is_foldable(c: Column) -> Column:
    return c.rlike(f"^[{PLAIN}]$")


def key_of(word: Column) -> Column:
    """az-lowered and without marks; words of a-z, which are their own keys, are not looked at letter by letter."""
    return F.when(word.rlike("^[a-z]+$"), word).otherwise(strip_diacritics(az_lower(word)))


def characters(c: Column) -> Column:
    """Code points as an array; the empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def to_labels(c: Column) -> Column:
    """1 where a foldable letter carries its mark, else 0, for each code point."""
    plain, typed = characters(strip_diacritics(c)), characters(c)
    return F.zip_with(plain, typed, lambda p, t: F.when((p != t) & is_foldable(p), 1).otherwise(0))


def apply_labels(plain: Column, labels: Column) -> Column:
    """Text from its stripped form and labels; different lengths are an error."""
    chars = characters(plain)
    text = F.array_join(F.zip_with(chars, labels, lambda p, l: F.when((l == 1) & is_foldable(p), mark(p)).otherwise(p)), "")
    return F.when(F.size(chars) == F.size(labels), text).otherwise(F.raise_error(F.lit("text and labels differ in length")).cast("string"))


def restore_with_labels(typed: Column, predicted: Column) -> Column:
    """Predicted marks joined with those already typed, which always stay."""
    return apply_labels(strip_diacritics(typed), F.zip_with(to_labels(typed), predicted, lambda a, b: F.greatest(a, b)))


def foldable_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{PLAIN}]"))


def foldable_positions(c: Column) -> Column:
    chars = characters(c)
    return F.filter(F.transform(chars, lambda x, i: F.when(is_foldable(x), i)), lambda i: i.isNotNull())


def is_upper(c: Column) -> Column:
    """Some letter has case and none is small."""
    return (c == F.upper(c)) & (c != F.lower(c))


def restore_case(typed: Column, form: Column) -> Column:
    """form with the capitals of typed."""
    first = F.substring(typed, 1, 1)
    return (
        F.when((F.length(typed) > 1) & is_upper(typed), az_upper(form))
        .when(is_upper(first), F.concat(az_upper(F.substring(form, 1, 1)), form.substr(F.lit(2), F.length(form))))
        .otherwise(form)
    )


def in_case_of(original: Column, word: Column) -> Column:
    """word with the capitals of original, its tail lower-cased."""
    first = az_upper(F.substring(word, 1, 1))
    rest = az_lower(word.substr(F.lit(2), F.length(word)))
    return (
        F.when((F.length(original) > 1) & is_upper(original), az_upper(word))
        .when(is_upper(F.substring(original, 1, 1)), F.concat(first, rest))
        .otherwise(az_lower(word))
    )


def letters_of(word: Column) -> Column:
    return F.regexp_replace(word, r"\P{L}", "")


def is_all_capitals(word: Column) -> Column:
    only = letters_of(word)
    return (F.length(only) > 1) & ~only.rlike(r"[^\p{Lu}]")


def case_of(word: Column, first: Column) -> Column:
    """all capitals / capitalised, first word / capitalised, mid-sentence / lowercase."""
    return (
        F.when(is_all_capitals(word), "all capitals")
        .when(is_upper(F.substring(word, 1, 1)), F.when(first, "capitalised, first word").otherwise("capitalised, mid-sentence"))
        .otherwise("lowercase")
    )


def keep_skeleton(typed: Column, candidate: Column) -> Column:
    """candidate where it differs from typed in marks alone, else typed."""
    return F.when(strip_diacritics(candidate) == strip_diacritics(typed), candidate).otherwise(typed)
