"""Context model: how often each spelling of an ambiguous key stands beside which neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmend.functions.words import END, START, UNKNOWN
from glyphmend.operators.stored import stored

VOCABULARY = 30_000
MOST_CONTEXTS, LEAST_CONTEXT = 200, 2
SMOOTHING = 1.0
FEATURES_WITHOUT_VOCABULARY = 50_000


def neighbour_vocabulary(lexicon: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """key, total of the most frequent keys, ties in order of the key."""
    return lexicon.groupBy("key").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "key").limit(size)


def as_features(rows: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """left and right as features: keys outside the vocabulary become the unknown one."""
    if vocabulary is None:
        return rows
    for side in ("left", "right"):
        known = vocabulary.select(F.col("key").alias(f"_{side}"))
        rows = rows.join(known, F.col(side) == F.col(f"_{side}"), "left")
        rows = rows.withColumn(side, F.when(F.col(side).isin(START, END), F.col(side)).otherwise(F.coalesce(f"_{side}", F.lit(UNKNOWN)))).drop(f"_{side}")
    return rows


def train(neighbours: DataFrame, ambiguous: DataFrame, vocabulary: DataFrame | None, *, order: tuple[str, ...] = ("doc_id", "pos")) -> tuple[DataFrame, DataFrame]:
    """(key, form, n, first_seen) and (key, form, side, feature, n) over tokens of ambiguous keys."""
    seen = as_features(neighbours.join(ambiguous.select("key"), "key", "left_semi"), vocabulary)
    both = seen.select("key", "form", F.struct(*order).alias("at"), F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("feature")) for s in ("left", "right")])).alias("x"))
    sides = both.groupBy("key", "form", F.col("x.side").alias("side"), F.col("x.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"))
    sides = stored(sides)
    # Every token has one feature on its left.
    forms = sides.where("side = 'left'").groupBy("key", "form").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    return forms, sides


def prune(sides: DataFrame, *, most: int = MOST_CONTEXTS, least: int = LEAST_CONTEXT) -> DataFrame:
    """The most frequent features of each form and side, seen often enough."""
    best = Window.partitionBy("key", "form", "side").orderBy(F.desc("n"), "first_seen", "feature")
    return sides.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= most) & (F.col("n") >= least)).drop("rank")


def scores(asked: DataFrame, forms: DataFrame, sides: DataFrame, features: int, smoothing: float = SMOOTHING) -> DataFrame:
    """The distinct (key, left, right) of asked, with each form of the key and its log score."""
    priors = forms.withColumn("total", F.sum("n").over(Window.partitionBy("key")))
    kept = sides.groupBy("key", "form").agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"kept_{s}") for s in ("left", "right")])
    priors = priors.join(kept, ["key", "form"], "left")
    rows = asked.select("key", "left", "right").distinct().join(priors, "key")
    for s in ("left", "right"):
        side = sides.where(F.col("side") == s).select("key", "form", F.col("feature").alias(s), F.col("n").alias(f"n_{s}"))
        rows = rows.join(side, ["key", "form", s], "left")
    def part(s: str) -> Column:
        return F.log((F.coalesce(f"n_{s}", F.lit(0)) + smoothing) / (F.coalesce(f"kept_{s}", F.lit(0)) + smoothing * features))
    score = F.log(F.col("n") / F.col("total")) + part("left") + part("right")
    return rows.select("key", "left", "right", "form", F.round(score, 9).alias("score"), "first_seen")


def best(scored: DataFrame) -> DataFrame:
    """key, left, right, form, score: the highest, ties to the form seen first."""
    top = F.min(F.struct((-F.col("score")).alias("m"), "first_seen", "form", "score")).alias("b")
    return scored.groupBy("key", "left", "right").agg(top).select("key", "left", "right", F.col("b.form").alias("form"), F.col("b.score").alias("score"))
