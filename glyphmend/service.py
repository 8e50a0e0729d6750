"""Request-shaped entry points: restore and check tables of requests, information, choice of restorer, command line."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmend.operators.restore import ContextRestorer, HybridRestorer, Identity, LexiconRestorer, changes
from glyphmend.sources import files

MAX_CHARACTERS = 10_000
VERSION = "0.1.0"


def restore_requests(requests: DataFrame, restorer, *, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """id, status (200, or 422 for a text over the limit), text, changes from (id, text) requests."""
    fine = requests.where(F.length("text") <= max_characters)
    out = restorer.transform(fine, id_col="id", text_col="text")
    found = changes(out, id_col="id", text_col="text").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("typed").alias("from"), "to"))).alias("changes"))
    rows = requests.select("id", F.length("text").alias("_n")).join(out.select("id", "restored"), "id", "left").join(found, "id", "left")
    return rows.select(
        "id", F.when(F.col("_n") <= max_characters, 200).otherwise(422).alias("status"), F.col("restored").alias("text"),
        F.coalesce("changes", F.array().cast("array<struct<start:bigint,end:bigint,from:string,to:string>>")).alias("changes"),
    )


def info(spark: SparkSession, restorer, sources: list[str]) -> DataFrame:
    return spark.createDataFrame([(VERSION, restorer.name, sources, MAX_CHARACTERS, False)], "version string, restorer string, sources array<string>, max_characters int, stores_text boolean")


def load_restorer(spark: SparkSession, *, lexicon: str | None = None, context: str | None = None, tagger=None):
    """Hybrid with a tagger and a lexicon, context with a lexicon and a context model, lexicon, else identity.

    Empty paths count as missing; a context model without a lexicon is ignored.
    """
    words = files.read_lexicon(spark, lexicon) if lexicon else None
    if tagger is not None and words is not None:
        return HybridRestorer(tagger, words)
    if words is not None and context:
        forms, sides, vocabulary = files.read_context(spark, context)
        return ContextRestorer(words, forms, sides, vocabulary, vocabulary.count() + 3)
    return LexiconRestorer(words) if words is not None else Identity()


def main(args: list[str] | None = None) -> int:
    """Restores the texts given, or standard input; 1: a file is missing, 2: no lexicon is named."""
    parser = argparse.ArgumentParser(prog="glyphmend", description="Puts diacritics back into texts typed without them.")
    parser.add_argument("text", nargs="*")
    parser.add_argument("--lexicon", default=os.environ.get("GLYPHMEND_LEXICON"))
    parser.add_argument("--which", action="store_true", help="say which restorer is used")
    parser.add_argument("--spell", metavar="VOCABULARY", help="show words that look misspelt instead")
    given = parser.parse_args(args)
    if not given.lexicon and not given.spell:
        print("no lexicon: name one with --lexicon", file=sys.stderr)
        return 2
    for path in (given.lexicon, given.spell):
        if path and not os.path.exists(path):
            print(f"no such file: {path}", file=sys.stderr)
            return 1
    spark = SparkSession.builder.appName("glyphmend").getOrCreate()
    lines = [" ".join(given.text)] if given.text else sys.stdin.read().splitlines()
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(lines) if x.strip()], "id long, text string")
    if given.spell:
        from glyphmend.operators.spelling import check

        for r in check(texts, *files.read_vocabulary(spark, given.spell)).orderBy("id", "start").collect():
            print(f"{r['typed']}: {', '.join(r['options'])}")
        return 0
    restorer = load_restorer(spark, lexicon=given.lexicon)
    if given.which:
        print(restorer.name)
    for r in restorer.transform(texts).orderBy("id").collect():
        print(r["restored"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
