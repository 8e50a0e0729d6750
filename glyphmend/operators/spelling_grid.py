"""How well the speller does: pairs of words and mistakes, and a grid of its settings."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmend.operators import spelling


def typo_pairs(tokens: DataFrame, words: DataFrame, count: int, *, edits: int = 1, seed: int = 0, least: int = spelling.MIN_COUNT) -> DataFrame:
    """key, typed: a reproducible sample of count words with mistakes that are no known words themselves."""
    made = spelling.typos(tokens.select("key").distinct(), edits=edits, seed=seed)
    known = words.where(F.col("n") >= least).select(F.col("key").alias("typed"))
    return made.join(known, "typed", "left_anti").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(count).select("key", "typed")


def settings(**values: list) -> list[dict]:
    """Every combination of the values named."""
    return [dict(zip(values, row)) for row in itertools.product(*values.values())]


def grid(pairs: DataFrame, clean: DataFrame, words: DataFrame, tried: list[dict]) -> DataFrame:
    """One row for each of the settings (min_count, min_stems, dominance, rare): pairs flagged, right first, right among three, and false alarms.

    pairs: (key, typed); clean: distinct keys of right words.  The settings are few, the words are not.
    """
    out = None
    for s in tried:
        least = s.get("min_count", spelling.MIN_COUNT)
        endings = spelling.suffixes(words, min_count=least, min_stems=s.get("min_stems", 1000))
        rules = {"min_count": least, "rare": s.get("rare", spelling.RARE), "dominance": s.get("dominance", spelling.DOMINANCE)}
        doubtful = spelling.suspicious(pairs.select(F.col("typed").alias("key")), words, endings, **rules)
        best = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("words"))
        found = spelling.candidates(doubtful, words, min_count=least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 3).where(F.size("words") == 1)
        hits = found.select(F.col("key").alias("typed"), F.col("words")[0].alias("key"), "rank")
        rows = pairs.join(doubtful.select(F.col("key").alias("typed"), F.lit(1).alias("flag")), "typed", "left").join(hits, ["typed", "key"], "left")
        score = rows.agg(F.count(F.lit(1)).alias("total"), F.count("flag").alias("flagged"), F.count_if(F.col("rank") == 1).alias("top1"), F.count("rank").alias("top3"))
        alarms = spelling.suspicious(clean, words, endings, **rules).agg(F.count(F.lit(1)).alias("false_alarms"))
        # Both sides are one row.
        row = score.join(F.broadcast(alarms)).select(*[F.lit(v).cast("double").alias(k) for k, v in s.items()], "total", "flagged", "top1", "top3", "false_alarms")
        out = row if out is None else out.unionByName(row)
    return out
