"""What training a tagger needs of a corpus: shouted copies, masked labels, batches of like length, the first so many."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmend.functions.letters import az_upper, characters, is_foldable, strip_diacritics, to_labels

#: The label of a character that has no accented reading.
IGNORED = -100


def drawn(seed: int, salt: int, *columns: Column) -> Column:
    """A number from 0 to 1 that hangs on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def shouted(text: Column, *, rate: float, seed: int = 0) -> Column:
    """text in capitals at a rate, else at the same rate with one word in capitals; as it is where capitals change its length."""
    words = F.split(text, " ")
    place = F.floor(drawn(seed, 3, text) * F.size(words)).cast("int")
    one = F.array_join(F.transform(words, lambda w, i: F.when(i == place, az_upper(w)).otherwise(w)), " ")
    loud = F.when(drawn(seed, 1, text) < rate, az_upper(text)).when(drawn(seed, 2, text) < rate, one).otherwise(text)
    return F.when(F.length(loud) == F.length(text), loud).otherwise(text)


def masked_labels(text: Column) -> Column:
    """One label a character: 1 marked, 0 plain, IGNORED where there is nothing to decide."""
    return F.zip_with(characters(strip_diacritics(text)), to_labels(text), lambda p, y: F.when(is_foldable(p), y).otherwise(IGNORED))


def first_rows(rows: DataFrame, count: int | None, *order: str) -> DataFrame:
    """The first count rows by position, or all."""
    return rows if count is None else rows.orderBy(*order).limit(count)


def length_batches(texts: DataFrame, *, text_col: str, size: int = 512, chunk: int = 64, seed: int = 0) -> DataFrame:
    """Adds chunk and batch: rows are shuffled into chunks of about chunk batches, and cut by length into batches of size rows."""
    chunks = max(1, math.ceil(texts.count() / (size * chunk)))
    rows = texts.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), F.col(text_col)), F.lit(chunks)).cast("int"))
    order = Window.partitionBy("chunk").orderBy(F.length(text_col), text_col)
    return rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
