"""Tables that several plans read: computed once, and broadcast only if they were counted and are small."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of words or contexts that a broadcast may have: some 100 MB.
SMALL = 1_000_000


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that ``spark.checkpoint.dir`` names.

    Where none is named and all runs on this machine, a folder of our own is used; a cluster without one is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphmend-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are; larger tables are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A stored df, to be broadcast if it has at most ``most`` rows; beyond, joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
