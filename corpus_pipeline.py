"""The training-data pipeline: toxicity, near duplicates, substring dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of documents.

Defined cases follow the operators: null and empty texts are not toxic; texts without words are copies of one another,
so one of them stays; rows whose text substring dedup empties go; mixing keeps what has words; repeated rows are
copies; ties go to the smaller id; very long texts are read whole; extra columns, whatever their names, are dropped by
the first stage; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmend.llm import toxicity
from glyphmend.llm.chunks import dedup_substrings
from glyphmend.llm.common import checkpointed, table
from glyphmend.llm.mixing import weighted_fair_mix
from glyphmend.llm.near_copies import near_copies
from glyphmend.llm.packing import pack_documents
from glyphmend.llm.queries import default_tokenizer
from glyphmend.llm.simhash import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_SCORE; the classifier learns from every labelled document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score_texts(docs, *model).where(F.col("_score") < TOXIC_SCORE).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles), that of the smallest doc_id."""
    return drop_near_duplicates(docs, find=near_copies).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents that are all repeats go."""
    out = dedup_substrings(docs)
    left = (F.col("_removed") == 0) | (F.trim(F.col("text")) != "")
    return out.where(left).withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, in order of virtual finish time; repeats are rows."""
    return weighted_fair_mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences, with their packed ids."""
    return pack_documents(docs, default_tokenizer(), keep_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the rolling hash and the tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them, rows go through the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
