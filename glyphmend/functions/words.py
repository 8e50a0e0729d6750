"""Words of texts: pattern, spans, tokens with neighbours, and texts put together again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmend.functions.letters import az_lower, key_of

LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:['’]{LETTER}+)*"
START, END, UNKNOWN = "<s>", "</s>", "<unk>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _running_sums(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: np.cumsum(x, dtype=np.int64), na_action="ignore")


def pieces(texts: DataFrame, *, id_col: str, text_col: str, beside: dict[str, str] | None = None, outer: bool = False, neighbours: bool = False, ends: bool = False) -> DataFrame:
    """id, pos, gap (what stands before the word), word; the last row's gap ends the text, its word is null.

    beside: further columns, name to column of a text whose words stand at the same places.  outer: a null text is one
    row without gap and word.  neighbours: before and after, the words beside or the sentinels, found inside the text.  ends:
    end, where the piece ends (code points), summed up inside the text.  Gaps and words are zipped before the explode, so no array is carried beside its own elements.
    """
    arrays = {"gap": F.split(F.col(text_col), WORD, -1), "word": words_of(F.col(text_col))} | {name: words_of(F.col(c)) for name, c in (beside or {}).items()}
    rows = texts.select(F.col(id_col), *[a.alias(f"_{name}") for name, a in arrays.items()])
    names = list(arrays)
    if neighbours:
        after = F.concat(F.slice("_word", 2, F.greatest(F.size("_word"), F.lit(1))), F.array(F.lit(END)))
        rows, names = rows.withColumns({"_before": F.concat(F.array(F.lit(START)), "_word"), "_after": after}), [*names, "before", "after"]
    if ends:
        # The gaps are one more than the words.
        lengths = F.zip_with("_gap", "_word", lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0)))
        rows, names = rows.withColumn("_end", _running_sums(lengths)), [*names, "end"]
    zipped = F.arrays_zip(*[F.col(f"_{name}").alias(name) for name in names])
    rows = rows.select(id_col, (F.posexplode_outer if outer else F.posexplode)(zipped).alias("pos", "p"))
    return rows.select(id_col, "pos", *[F.col(f"p.{name}").alias(name) for name in names])


def tokens(texts: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, pos, word, form (az-lowered), key."""
    rows = texts.select(F.col(id_col), F.posexplode(words_of(F.col(text_col))).alias("pos", "word"))
    return rows.withColumn("form", az_lower(F.col("word"))).withColumn("key", key_of(F.col("word")))


def neighbour_keys(rows: DataFrame) -> DataFrame:
    """left and right, the keys of before and after."""
    return rows.withColumns({"left": key_of(F.col("before")), "right": key_of(F.col("after"))}).drop("before", "after")


def neighboured(texts: DataFrame, *, id_col: str, text_col: str, keys: DataFrame | None = None) -> DataFrame:
    """tokens with left and right, the keys beside, found inside the text: nothing is shuffled or sorted.

    keys: only the tokens of these keys, whose neighbours alone are then looked at.
    """
    rows = pieces(texts, id_col=id_col, text_col=text_col, neighbours=True).where("word is not null").drop("gap").withColumn("key", key_of(F.col("word")))
    if keys is not None:
        rows = rows.join(keys.select("key"), "key", "left_semi")
    return neighbour_keys(rows).withColumn("form", az_lower(F.col("word")))


def with_words(text: Column, changed: Column) -> Column:
    """text with the words at some places replaced; changed: (pos, out) structs in order of pos, or null."""

    def spliced(x: Column) -> Column:
        words = x["words"]
        starts = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("out"))), changed)
        ends = F.concat(F.transform(changed, lambda c: c["pos"]), F.array(F.size(words)))
        none = F.array().cast("array<string>")
        # Stretches of unchanged words are cut out once each.
        parts = F.zip_with(starts, ends, lambda s, e: F.concat(F.when(s["out"].isNull(), none).otherwise(F.array(s["out"])), F.slice(words, s["pos"] + 2, e - s["pos"] - 1)))
        return F.array_join(F.zip_with(x["gaps"], F.flatten(parts), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    # An array of one, so that the text is cut up once and not for every place.
    cut = F.array(F.struct(words_of(text).alias("words"), F.split(text, WORD, -1).alias("gaps")))
    return F.when(changed.isNull(), text).otherwise(F.transform(cut, spliced)[0])


def spans(rows: DataFrame, *, id_col: str) -> DataFrame:
    """The rows of ``pieces`` that have a word, with start and end (code points); other columns are kept.

    Rows with the end of their piece keep it; else a text's rows meet in a window.
    """
    if "end" not in rows.columns:
        before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("end", F.sum(F.length("gap") + F.coalesce(F.length("word"), F.lit(0))).over(before).cast("long"))
    return rows.where("word is not null").withColumn("start", F.col("end") - F.length("word"))


def text_spans(texts: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, pos, start, end (code points), word, gap."""
    return spans(pieces(texts, id_col=id_col, text_col=text_col, ends=True), id_col=id_col).select(id_col, "pos", "start", "end", "word", "gap")


def with_neighbours(rows: DataFrame, *, id_col: str) -> DataFrame:
    """Adds left and right, the keys of the words beside, or the sentinels; a row without a word ends its text."""
    w = Window.partitionBy(id_col).orderBy("pos")
    return rows.withColumn("left", F.lag("key", 1, START).over(w)).withColumn("right", F.coalesce(F.lead("key", 1).over(w), F.lit(END)))


def joined(rows: DataFrame, *, id_col: str, word_col: str, out: str) -> DataFrame:
    """id and the text of (pos, gap, word_col) rows."""
    piece = F.concat(F.col("gap"), F.coalesce(F.col(word_col), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("pos"), piece.alias("piece"))))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias(out))


def opens_sentence(pos: Column, gap: Column) -> Column:
    """Nothing but blanks before the word, or a sentence end and blanks."""
    return ((pos == 0) & ~gap.rlike(r"\S")) | gap.rlike(r"[.!?…]\s*$")
