"""Restorers: texts typed without diacritics to texts with them, under the contract that only marks change.

A restorer takes texts (id, text) and returns (id, text, restored).  Spellings are found once for each distinct
word, in tables that are built once; those that are counted and small are broadcast.  Only the words that change are
shuffled to their text, which is spliced with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmend.functions.letters import ACCENTED, PLAIN, characters, is_foldable, keep_skeleton, key_of, restore_case, strip_diacritics
from glyphmend.functions.words import neighbour_keys, pieces, spans, with_neighbours, with_words, words_of
from glyphmend.operators import context as ctx
from glyphmend.operators.lexicon import ambiguous_keys, best_forms
from glyphmend.operators.stored import small, stored


def applied(word: Column, form: Column) -> Column:
    """The form in the word's case, or the word if there is none or its skeleton differs."""
    return F.when(form.isNull(), word).otherwise(keep_skeleton(word, restore_case(word, form)))


def keyed_pieces(texts: DataFrame, *, id_col: str, text_col: str, beside: dict[str, str] | None = None) -> DataFrame:
    """The pieces of texts with the key of each word."""
    return pieces(texts, id_col=id_col, text_col=text_col, beside=beside, outer=True).withColumn("key", key_of(F.col("word")))


def word_rows(texts: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, pos, word."""
    return texts.select(F.col(id_col), F.posexplode(words_of(F.col(text_col))).alias("pos", "word"))


def _meeting(key: str, id_col: str) -> Column:
    """The key to join by: rows without a word meet nothing, and are spread by their text."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(id_col).cast("string")))


def put_together(texts: DataFrame, changed: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, text, restored: texts with the (id, pos, out) words in place; only changed words are shuffled to their text."""
    by_text = changed.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "out"))).alias("_changed"))
    rows = texts.select(id_col, text_col).join(by_text, F.col(id_col) == F.col("_id"), "left")
    return rows.select(id_col, text_col, with_words(F.col(text_col), F.col("_changed")).alias("restored"))


@dataclass
class Identity:
    name: str = "identity"

    def transform(self, texts: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
        return texts.select(id_col, text_col, F.col(text_col).alias("restored"))


@dataclass
class LexiconRestorer:
    """The most frequent spelling of each word."""

    lexicon: DataFrame
    name: str = "lexicon"
    _best: list = field(default_factory=list, repr=False)

    def best(self) -> DataFrame:
        """_key, _form of every key; found once."""
        if not self._best:
            self._best.append(small(stored(best_forms(self.lexicon).select(F.col("key").alias("_key"), F.col("form").alias("_form")))))
        return self._best[0]

    def rewrites(self, words: DataFrame) -> DataFrame:
        """_word, _out of the distinct words that change."""
        asked = words.where("word is not null").select("word").distinct().withColumn("key", key_of(F.col("word")))
        out = asked.join(self.best(), F.col("key") == F.col("_key")).select(F.col("word").alias("_word"), applied(F.col("word"), F.col("_form")).alias("_out"))
        return small(stored(out.where("_word <> _out")))

    def words(self, rows: DataFrame, *, id_col: str) -> DataFrame:
        """Adds out to (id, word) rows: each distinct word is looked up once."""
        met = rows.join(self.rewrites(rows), _meeting("word", id_col) == F.col("_word"), "left")
        return met.withColumn("out", F.coalesce("_out", "word")).drop("_word", "_out")

    def transform(self, texts: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
        rows = word_rows(texts, id_col=id_col, text_col=text_col)
        changed = rows.join(self.rewrites(rows), F.col("word") == F.col("_word")).select(id_col, "pos", F.col("_out").alias("out"))
        return put_together(texts, changed, id_col=id_col, text_col=text_col)


@dataclass
class ContextRestorer:
    """The spelling that fits the neighbours, where it leads the most frequent one by ``margin``."""

    lexicon: DataFrame
    forms: DataFrame
    sides: DataFrame
    vocabulary: DataFrame | None
    features: int
    margin: float = 0.0
    smoothing: float = ctx.SMOOTHING
    name: str = "context"
    _fallback: list = field(default_factory=list, repr=False)

    def fallback(self) -> LexiconRestorer:
        if not self._fallback:
            self._fallback.append(LexiconRestorer(self.lexicon))
        return self._fallback[0]

    def choices(self, asked: DataFrame) -> DataFrame:
        """key, left, right and the chosen form, for the distinct triples of asked."""
        scored = ctx.scores(asked, self.forms, self.sides, self.features, self.smoothing)
        top = ctx.best(scored).withColumnRenamed("form", "chosen").withColumnRenamed("score", "lead")
        if self.margin <= 0:
            # The highest score leads any other by nothing at least.
            return top.select("key", "left", "right", F.col("chosen").alias("_form"))
        fallback = self.fallback().best().select(F.col("_key").alias("key"), F.col("_form").alias("fallback"))
        own = scored.select("key", "left", "right", F.col("form").alias("fallback"), F.col("score").alias("base"))
        rows = top.join(fallback, "key", "left").join(own, ["key", "left", "right", "fallback"], "left")
        # A fallback that the model does not know scores nothing: any lead is wide enough.
        wide = F.col("base").isNull() | (F.col("lead") - F.col("base") >= self.margin)
        return rows.select("key", "left", "right", F.when(F.col("fallback").isNull() | wide, F.col("chosen")).otherwise(F.col("fallback")).alias("_form"))

    def changed(self, rows: DataFrame, *, id_col: str) -> DataFrame:
        """id, pos, out of the words that change, of (id, pos, word, before, after) rows."""
        distinct = rows.select("word").distinct().withColumn("key", key_of(F.col("word")))
        # Words of keys that the model has forms of are decided by their neighbours, all others by the lexicon.
        unsure = small(stored(distinct.join(self.forms.select("key").distinct(), "key", "left_semi").select(F.col("word").alias("_unsure"), "key")))
        plain = self.fallback().rewrites(distinct).join(unsure, F.col("_word") == F.col("_unsure"), "left_anti")
        sure = rows.join(small(stored(plain)), F.col("word") == F.col("_word")).select(id_col, "pos", F.col("_out").alias("out"))
        near = ctx.as_features(neighbour_keys(rows.join(unsure, F.col("word") == F.col("_unsure"))), self.vocabulary)
        near = stored(near.select(id_col, "pos", "word", "key", "left", "right"))
        chosen = near.join(small(stored(self.choices(near))), ["key", "left", "right"]).withColumn("out", applied(F.col("word"), F.col("_form")))
        return sure.unionByName(chosen.where("out <> word").select(id_col, "pos", "out"))

    def transform(self, texts: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
        rows = pieces(texts, id_col=id_col, text_col=text_col, neighbours=True).where("word is not null")
        return put_together(texts, self.changed(rows, id_col=id_col), id_col=id_col, text_col=text_col)


@dataclass
class HybridRestorer:
    """A tagger's words, overruled by the lexicon where it is unanimous and well attested."""

    tagger: Callable[[DataFrame], DataFrame]
    lexicon: DataFrame
    context: ContextRestorer | None = None
    min_count: int = 3
    name: str = "hybrid"
    _sure: list = field(default_factory=list, repr=False)

    def sure(self) -> DataFrame:
        """_key, _sure of the keys with one spelling, seen often enough; found once."""
        if not self._sure:
            rows = best_forms(self.lexicon).where((F.col("forms") == 1) & (F.col("n") >= self.min_count))
            self._sure.append(small(stored(rows.select(F.col("key").alias("_key"), F.col("form").alias("_sure")))))
        return self._sure[0]

    def words(self, texts: DataFrame, *, id_col: str, text_col: str, changed: bool = False) -> DataFrame:
        """id, pos, gap, word, key, out, source (dictionary where the lexicon decides, else model); with its end.

        changed: only the words that change.  Words that neither the tagger nor the lexicon would change then leave before
        the others meet the lexicon.
        """
        tagged = self.tagger(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(F.col("id").alias(id_col), F.col("restored").alias("_tagged"))
        both = texts.select(id_col, text_col).join(tagged, id_col)
        rows = pieces(both, id_col=id_col, text_col=text_col, beside={"_word": "_tagged"}, outer=True, ends=True)
        if changed and self.context is None:
            asked = word_rows(texts, id_col=id_col, text_col=text_col).select("word").distinct().withColumn("key", key_of(F.col("word")))
            known = asked.join(self.sure(), F.col("key") == F.col("_key")).where(applied(F.col("word"), F.col("_sure")) != F.col("word"))
            rows = rows.where("word is not null").join(small(stored(known.select(F.col("word").alias("_known")))), F.col("word") == F.col("_known"), "left")
            rows = rows.where(F.col("_known").isNotNull() | (F.col("_word") != F.col("word"))).drop("_known")
        rows = rows.withColumn("key", key_of(F.col("word")))
        rows = rows.join(self.sure(), _meeting("key", id_col) == F.col("_key"), "left").drop("_key")
        if self.context is not None:
            unsure = small(stored(ambiguous_keys(self.lexicon).select(F.col("key").alias("_akey"))))
            placed = with_neighbours(rows, id_col=id_col)
            placed = ctx.as_features(placed.join(unsure, F.col("key") == F.col("_akey"), "left_semi"), self.context.vocabulary)
            best = ctx.best(ctx.scores(placed, self.context.forms, self.context.sides, self.context.features, self.context.smoothing))
            chosen = placed.join(best.select("key", "left", "right", F.col("form").alias("_context")), ["key", "left", "right"], "left").select(id_col, "pos", "_context")
            rows = rows.join(chosen, [id_col, "pos"], "left").withColumn("_sure", F.coalesce("_sure", "_context")).drop("_context")
        out = F.when(F.col("_sure").isNull(), F.col("_word")).otherwise(applied(F.col("word"), F.col("_sure")))
        rows = rows.withColumn("out", out).withColumn("source", F.when(F.col("_sure").isNull(), "model").otherwise("dictionary")).drop("_word", "_sure")
        return rows.where("word <> out") if changed else rows

    def transform(self, texts: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """tagger: (id, text) rows to (id, restored) rows of equal length."""
        changed = self.words(texts, id_col=id_col, text_col=text_col, changed=True).select(id_col, "pos", "out")
        return put_together(texts, changed, id_col=id_col, text_col=text_col)


def changes(restored: DataFrame, *, id_col: str, text_col: str, out_col: str = "restored") -> DataFrame:
    """id, start, end, typed, to of every word that a restorer changed; texts of unequal length are an error."""
    fine = F.when(F.length(text_col) == F.length(out_col), F.col(out_col)).otherwise(F.raise_error(F.lit("texts differ in length")).cast("string"))
    rows = restored.select(id_col, F.col(text_col).alias("_a"), fine.alias("_b"))
    # Only marks differ, so the words of both texts stand at the same places.
    return changed_words(pieces(rows, id_col=id_col, text_col="_a", beside={"out": "_b"}, ends=True), id_col=id_col)


def changed_words(rows: DataFrame, *, id_col: str) -> DataFrame:
    """id, start, end, typed, to of the changed words of (id, pos, gap, word, out) rows."""
    placed = spans(rows, id_col=id_col)
    return placed.where("word <> out").select(id_col, "start", "end", F.col("word").alias("typed"), F.col("out").alias("to"))


@F.pandas_udf(T.StringType())
def _replaced(texts: pd.Series, stretches: pd.Series) -> pd.Series:
    """texts with the stretches (start, end, to), in order of start, replaced; each text is gone through once."""

    def one(text: str, found: list | None) -> str:
        parts, at = [], 0
        for x in found if found is not None else ():
            if x["start"] >= at:
                parts += [text[at : x["start"]], x["to"]]
                at = x["end"]
        return "".join(parts) + text[at:]

    return pd.Series([one(t, s) for t, s in zip(texts, stretches)], dtype=object)


def revert(found: DataFrame, texts: DataFrame, rejected: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Texts with all changes but the rejected (id, start) ones: only kept changes are shuffled to their text."""
    kept = found.join(rejected.select(id_col, "start"), [id_col, "start"], "left_anti")
    by_text = kept.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "to"))).alias("_kept"))
    rows = texts.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(by_text, F.col(id_col) == F.col("_id"), "left")
    out = F.coalesce(_replaced(F.when(F.col("_kept").isNotNull(), F.col(text_col)).otherwise(""), F.col("_kept")), F.lit(""))
    return rows.select(id_col, F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(out).alias("restored"))


def restored_letters(typed: Column, restored: Column) -> Column:
    """How many letters got a mark."""
    pairs = F.zip_with(characters(typed), characters(restored), lambda a, b: (a != b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def edit_stretch(typed: Column, restored: Column) -> Column:
    """The least stretch (start, end, to) that makes restored of typed, texts of equal length; null if they are equal."""
    places = F.sequence(F.lit(0), F.greatest(F.length(typed) - 1, F.lit(0)))
    pairs = F.arrays_zip(characters(typed).alias("a"), characters(restored).alias("b"), places.alias("i"))
    at = F.transform(F.filter(pairs, lambda x: x["a"] != x["b"]), lambda x: x["i"])
    start, end = F.array_min(at), F.array_max(at) + 1
    return F.when(F.size(at) > 0, F.struct(start.alias("start"), end.alias("end"), restored.substr(start + 1, end - start).alias("to")))


def letter_view(typed: Column, probability: Column, dictionary: Column | None = None) -> Column:
    """For each code point: null if it has no accented reading, else probability, marked and source.

    dictionary: the text as the lexicon would have it, null where it says nothing; what was typed with a mark comes
    first, then the dictionary, then the model.
    """
    plain = strip_diacritics(typed)
    rows = F.arrays_zip(characters(plain).alias("p"), characters(typed).alias("t"), probability.alias("m"), (F.array() if dictionary is None else characters(dictionary)).cast("array<string>").alias("d"))

    def view(x: Column) -> Column:
        already, said = x["p"] != x["t"], x["d"].isNotNull()
        marked = already | F.when(said, x["d"] != x["p"]).otherwise(x["m"] > 0.5)
        sure = F.when(already | (said & marked), F.lit(1.0)).when(said, F.lit(0.0)).otherwise(x["m"])
        return F.when(is_foldable(x["p"]), F.struct(sure.alias("probability"), marked.alias("marked"), F.when(already, "typed").when(said, "dictionary").otherwise("model").alias("source")))

    return F.transform(rows, view)


def unsure_letters(view: Column, low: float = 0.1, high: float = 0.9) -> Column:
    return F.filter(view, lambda x: x.isNotNull() & (x["source"] == "model") & (x["probability"] > low) & (x["probability"] < high))


def explained(rows: DataFrame, letters: DataFrame, *, id_col: str) -> DataFrame:
    """id, start, end, typed, to, source, confidence of the changed words of (id, pos, gap, word, out, source) rows.

    letters: (id, at, probability) of every foldable letter.  A word of the model is as sure as its least sure letter (the
    probability of what was decided); the dictionary gives no confidence.  Letters that the model is certain of cannot be
    the least sure one unless all are, so only the others meet the words.
    """
    placed = spans(rows, id_col=id_col).where("word <> out")
    decided = F.greatest("probability", 1 - F.col("probability"))
    spots = placed.where("source = 'model'").select(id_col, "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"))
    doubtful = letters.select(id_col, F.col("at").cast("long").alias("at"), decided.alias("p")).where("p < 1")
    least = spots.join(doubtful, [id_col, "at"]).groupBy(id_col, "start").agg(F.min("p").alias("confidence"))
    sure = F.when((F.col("source") == "model") & F.col("word").rlike(f"[{PLAIN}{ACCENTED}]"), F.lit(1.0))
    return placed.join(least, [id_col, "start"], "left").select(id_col, "start", "end", F.col("word").alias("typed"), F.col("out").alias("to"), "source", F.coalesce("confidence", sure).alias("confidence"))
