"""Lexicon of spellings: (key, form, n, first_seen) rows by distributed counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmend.functions.letters import az_lower, key_of

#: Places that a text may have, for a place as one number.
PLACES = 1 << 31
#: A key is ambiguous if its second spelling was seen so often, and in this share of all.
LEAST_COUNT, LEAST_SHARE = 10, 0.05


def count_words(tokens: DataFrame, by: tuple[str, ...] = ("word",), *, order: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """The ``by`` columns, n and first_seen (the least struct of order).

    A place of two whole numbers is held as one decimal while it is compared: a struct would make Spark sort all
    tokens, where numbers are counted in hash tables.
    """
    kinds = {f.name: f.dataType for f in tokens.schema.fields}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if len(order) != 2 or not isinstance(kinds[order[0]], whole) or not isinstance(kinds[order[1]], whole[:3]) or any(tokens.schema[c].nullable and c != order[0] for c in order):
        return tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first_seen"))
    # Ids without a value come first, as in a struct; places in a text are 0 or more.
    place = F.coalesce(F.col(order[0]).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(PLACES).cast("decimal(10,0)") + F.col(order[1])
    counted = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_at"))
    pos = F.pmod("_at", F.lit(PLACES).cast("decimal(10,0)"))
    first = ((F.col("_at") - pos) / F.lit(PLACES).cast("decimal(10,0)")).cast("decimal(20,0)")
    back = [F.when(first >= F.lit(str(-(1 << 63))).cast("decimal(20,0)"), first).cast(kinds[order[0]]).alias(order[0]), pos.cast(kinds[order[1]]).alias(order[1])]
    return counted.select(*by, "n", F.struct(*back).alias("first_seen"))


def build_lexicon(tokens: DataFrame, *, order: tuple[str, ...] = ("doc_id", "pos"), words: bool = False) -> DataFrame:
    """key, form, n, first_seen from (key, form) tokens with order columns; partial sums before the shuffle.

    Tokens with a word, on which form and key hang, are counted by it first, so letters are looked at once a distinct word.
    words: adds words, the distinct words of a form, with their capitals.
    """
    if "word" not in tokens.columns:
        return count_words(tokens, ("key", "form"), order=order)
    rows = count_words(tokens, order=order).withColumn("form", az_lower(F.col("word"))).withColumn("key", key_of(F.col("word")))
    more = [F.collect_list("word").alias("words")] if words else []
    return rows.groupBy("key", "form").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), *more)


def ranked(lexicon: DataFrame) -> DataFrame:
    """Adds rank (1: most frequent, ties to the first seen), total and forms of the key."""
    best = Window.partitionBy("key").orderBy(F.desc("n"), "first_seen")
    all_of = Window.partitionBy("key")
    return lexicon.withColumn("rank", F.row_number().over(best)).withColumn("total", F.sum("n").over(all_of)).withColumn("forms", F.count(F.lit(1)).over(all_of))


def best_forms(lexicon: DataFrame) -> DataFrame:
    """key, form, n, total, forms of each key's most frequent spelling."""
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col("first_seen"), F.col("form"), F.col("n"))).alias("b")
    return lexicon.groupBy("key").agg(top, F.sum("n").alias("total"), F.count(F.lit(1)).alias("forms")).select("key", F.col("b.form").alias("form"), F.col("b.n").alias("n"), "total", "forms")


def key_facts(lexicon: DataFrame, *, least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE, usual: float = 0.95) -> DataFrame:
    """All that is asked of a key, in one pass: key, form, n, total, forms, runner_up, is_ambiguous, usual (its dominant form, or null)."""
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col("first_seen"), F.col("form"), F.col("n"))).alias("b")
    second = F.get(F.sort_array(F.collect_list("n"), asc=False), F.lit(1))
    rows = lexicon.groupBy("key").agg(top, F.sum("n").alias("total"), F.count(F.lit(1)).alias("forms"), second.alias("runner_up"))
    unsure = F.coalesce((F.col("runner_up") >= least_count) & (F.col("runner_up") / F.col("total") >= least_share), F.lit(False))
    rows = rows.select("key", F.col("b.form").alias("form"), F.col("b.n").alias("n"), "total", "forms", "runner_up", unsure.alias("is_ambiguous"))
    return rows.withColumn("usual", F.when(F.col("n") / F.col("total") >= usual, F.col("form")))


def ambiguous_keys(lexicon: DataFrame, *, least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE) -> DataFrame:
    """key, runner_up, total of keys whose second spelling counts."""
    counts = F.sort_array(F.collect_list("n"), asc=False)
    rows = lexicon.groupBy("key").agg(F.get(counts, F.lit(1)).alias("runner_up"), F.sum("n").alias("total"))
    return rows.where((F.col("runner_up") >= least_count) & (F.col("runner_up") / F.col("total") >= least_share))


def prune(lexicon: DataFrame, least: int = 2) -> DataFrame:
    return lexicon.where(F.col("n") >= least)


def candidates(lexicon: DataFrame) -> DataFrame:
    """key and its forms, most frequent first, as (form, n) structs."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "first_seen", "form", "n")))
    return lexicon.groupBy("key").agg(F.transform(ordered, lambda x: F.struct(x["form"].alias("form"), x["n"].alias("n"))).alias("candidates"))


def confident(lexicon: DataFrame, *, least: int = 2) -> DataFrame:
    """key, form, n of keys with one spelling, seen often enough, that has marks."""
    return best_forms(lexicon).where((F.col("forms") == 1) & (F.col("n") >= least) & (F.col("form") != F.col("key"))).select("key", "form", "n")


def dominant_forms(lexicon: DataFrame, share: float = 0.95) -> DataFrame:
    return best_forms(lexicon).where(F.col("n") / F.col("total") >= share).select("key", "form")


def stats(tokens: DataFrame, lexicon: DataFrame, *, least: int = 2) -> DataFrame:
    """One row: texts, tokens, keys before and after pruning, ambiguous keys and their share of tokens."""
    kept = prune(lexicon, least)
    ambiguous = ambiguous_keys(kept).select("key")
    per_key = lexicon.groupBy("key").agg(F.sum("n").alias("n"))
    shares = per_key.join(ambiguous.withColumn("hit", F.lit(1)), "key", "left").agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("keys"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("ambiguous_tokens"), F.count("hit").alias("ambiguous_keys")
    )
    after = kept.agg(F.countDistinct("key").alias("keys_pruned"))
    # Both sides are one row.
    return shares.join(after).select("tokens", "keys", "keys_pruned", "ambiguous_keys", F.round(F.try_divide("ambiguous_tokens", "tokens"), 4).alias("ambiguous_share"))
