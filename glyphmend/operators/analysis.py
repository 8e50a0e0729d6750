"""Error analysis and text statistics over (expected, produced) words and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmend.functions.letters import az_lower, case_of, characters, is_all_capitals, is_upper, key_of, strip_diacritics
from glyphmend.functions.sentences import split_name
from glyphmend.functions.words import words_of
from glyphmend.operators.lexicon import ambiguous_keys, key_facts

FOLDABLE_KEY = "[cegiosu]"
# The letters that a plain keyboard lacks.
MISSING = "çəğıöşü"


def capitals(words: DataFrame) -> DataFrame:
    """total and right of the words all in capitals that could be wrong."""
    rows = words.where(is_all_capitals(F.col("expected")) & F.col("key").rlike(FOLDABLE_KEY))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum((F.col("expected") == F.col("produced")).cast("long")), F.lit(0)).alias("correct"))


def error_kinds(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """kind, words, errors: by case, and overlapping them by what training knows of the word.

    Equal words are counted first, so only distinct ones meet what is known of their key.
    """
    facts = key_facts(lexicon).select(F.col("key").alias("_key"), "is_ambiguous", "usual")
    first = F.col("pos") == 0
    distinct = words.where(F.col("key").rlike(FOLDABLE_KEY)).groupBy("key", "expected", "produced", first.alias("_first")).agg(F.count(F.lit(1)).alias("_n"))
    rows = distinct.join(facts, F.col("key") == F.col("_key"), "left")
    wrong = F.col("expected") != F.col("produced")
    kinds = F.array_compact(
        F.array(
            case_of(F.col("expected"), F.col("_first")),
            F.when(F.col("_key").isNull(), "never seen in training").when(F.col("is_ambiguous"), "ambiguous"),
            F.when(wrong & (F.col("usual") == az_lower(F.col("produced"))), "wrote the usual spelling"),
            F.when(wrong, "all"),
        )
    )
    each = rows.select(F.explode(kinds).alias("kind"), "_n", F.when(wrong, F.col("_n")).otherwise(0).alias("_wrong"))
    return each.groupBy("kind").agg(F.sum("_n").alias("words"), F.sum("_wrong").alias("errors"))


def kind_shares(kinds: DataFrame) -> DataFrame:
    """kind, words, errors with share_of_words, share_of_errors and rate; the kind ``all`` has the errors of all words."""
    # The totals are one row.
    sums = kinds.agg(F.max(F.when(F.col("kind") == "all", F.col("errors"))).alias("all_errors"), F.sum(F.when(F.col("kind").rlike("^(all capitals|capitalised, .*|lowercase)$"), F.col("words"))).alias("all_words"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return kinds.join(F.broadcast(sums)).select("kind", "words", "errors", share("words", "all_words").alias("share_of_words"), share("errors", "all_errors").alias("share_of_errors"), share("errors", "words").alias("rate"))


def mistakes(words: DataFrame, limit: int = 50) -> DataFrame:
    rows = words.where((F.col("expected") != F.col("produced")) & F.col("key").rlike(FOLDABLE_KEY))
    counts = rows.groupBy(az_lower(F.col("expected")).alias("expected"), az_lower(F.col("produced")).alias("produced")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "expected", "produced").limit(limit)


def in_training(rows: DataFrame, *, id_col: str) -> DataFrame:
    """The rows whose document belongs to the training split."""
    return rows.where(split_name(F.col(id_col).cast("string")) == "train")


def title_names(titles: DataFrame, *, title_col: str) -> DataFrame:
    """key, word, n of the name-like words of titles."""
    rows = titles.select(F.explode(words_of(F.col(title_col))).alias("word")).withColumn("key", key_of(F.col("word")))
    return rows.where(is_upper(F.substring("word", 1, 1)) & F.col("key").rlike(FOLDABLE_KEY)).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))


def capitalised(words: DataFrame) -> DataFrame:
    """expected, produced, n of capitalised words inside a text, not all in capitals."""
    rows = words.where((F.col("pos") > 0) & is_upper(F.substring("expected", 1, 1)) & ~is_all_capitals(F.col("expected")))
    return rows.groupBy("expected", "produced").agg(F.count(F.lit(1)).alias("n"))


def name_rules(pairs: DataFrame, names: DataFrame, lexicon: DataFrame, *, least: int = 4) -> DataFrame:
    """rule, changed, fixed, broken, net of five rules that spell names as titles do."""
    one = names.groupBy("key").agg(F.max("word").alias("spelling"), F.sum("n").alias("titles"), F.count(F.lit(1)).alias("ways")).where("ways = 1").select("key", "spelling", "titles")
    seen = lexicon.groupBy("key").agg(F.sum("n").alias("seen"))
    alone = one.join(seen, "key", "left").select(F.col("key").alias("_key"), "spelling", "titles", F.coalesce("seen", F.lit(0)).alias("seen"))
    rows = pairs.withColumn("key", key_of(F.col("expected"))).withColumn("typed", strip_diacritics(F.col("expected")))
    exact = rows.join(alone, F.col("key") == F.col("_key"))
    by_key = [("titles spell it one way", F.lit(True)), ("and training never saw the word", F.col("seen") == 0), ("and it is in two titles", F.col("titles") >= 2)]
    proposals = [exact.where(when).select(F.lit(rule).alias("rule"), "expected", "produced", "n", F.col("spelling").alias("proposed")) for rule, when in by_key]
    # A name and a suffix: the longest prefix that is a name.
    cuts = rows.where(F.length("typed") >= least).withColumn("cut", F.explode(F.sequence(F.lit(least), F.length("typed"))))
    found = cuts.withColumn("prefix", key_of(F.expr("substring(typed, 1, cut)"))).join(alone, F.col("prefix") == F.col("_key")).where(F.length("spelling") == F.col("cut"))
    for rule, when in (("a name and a suffix", F.lit(True)), ("and training never saw the name", F.col("seen") == 0)):
        best = found.where(when).groupBy("expected", "produced", "n").agg(F.max_by("spelling", "cut").alias("spelling"), F.max("cut").alias("cut"))
        proposals.append(best.select(F.lit(rule).alias("rule"), "expected", "produced", "n", F.concat("spelling", F.expr("substring(produced, cut + 1)")).alias("proposed")))
    every = proposals[0]
    for p in proposals[1:]:
        every = every.unionByName(p)
    changed = every.where("proposed <> produced")
    fixed = F.sum(F.when((F.col("produced") != F.col("expected")) & (F.col("proposed") == F.col("expected")), F.col("n")).otherwise(0))
    broken = F.sum(F.when(F.col("produced") == F.col("expected"), F.col("n")).otherwise(0))
    return changed.groupBy("rule").agg(F.sum("n").alias("changed"), fixed.alias("fixed"), broken.alias("broken")).withColumn("net", F.col("fixed") - F.col("broken"))


def letter_histogram(texts: DataFrame, *, text_col: str) -> DataFrame:
    """letter, n over az-lowered letters; partial counts leave each task."""
    chars = texts.select(F.explode(characters(az_lower(F.col(text_col)))).alias("letter"))
    return chars.where(F.col("letter").rlike(r"\p{L}")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


def text_stats(texts: DataFrame, *, text_col: str) -> DataFrame:
    """One row: sentences, words, words a sentence, letters, and the share of letters that plain keyboards lack."""
    lower = az_lower(F.col(text_col))
    sums = texts.agg(
        F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum(F.size(words_of(F.col(text_col)))), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.sum(F.regexp_count(lower, F.lit(r"\p{L}"))), F.lit(0)).cast("long").alias("letters"),
        F.coalesce(F.sum(F.regexp_count(lower, F.lit(f"[{MISSING}]"))), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.sum(F.regexp_count(lower, F.lit("ə"))), F.lit(0)).cast("long").alias("e_turned"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return sums.select("*", ratio("words", "sentences").alias("words_per_sentence"), ratio("missing", "letters").alias("missing_share"))


def threshold_sweep(words: DataFrame, lexicon: DataFrame, shares: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.2), *, least_count: int = 10) -> DataFrame:
    """share, ambiguous, correct: the same words scored under several bounds of ambiguity, in one pass."""
    second = ambiguous_keys(lexicon, least_count=least_count, least_share=min(shares)).select("key", (F.col("runner_up") / F.col("total")).alias("part"))
    rows = words.join(second, "key")
    # One literal row a bound.
    return (
        rows.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).where(F.col("part") >= F.col("share"))
        .groupBy("share").agg(F.count(F.lit(1)).alias("ambiguous"), F.sum((F.col("expected") == F.col("produced")).cast("long")).alias("correct"))
    )
