"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words in this subpackage.
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is set only where none is configured and all runs on this machine (tests); a cluster
    without one is an error, as executors would lose what they wrote.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphmend-"))
    return df.checkpoint()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_row(docs: DataFrame, names: list[str] | None = None) -> Column:
    """The named columns of docs (default: all) in one struct, so that no name of theirs can clash with ours."""
    names = docs.columns if names is None else names
    return F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_")).alias("_row")


def unpacked(names: list[str], **replaced: Column) -> list[Column]:
    """Columns out of ``whole_row``, some of them replaced."""
    return [(replaced[c] if c in replaced else F.col("_row").getField(c)).alias(c) for c in names]
