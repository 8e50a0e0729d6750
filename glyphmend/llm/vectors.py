"""What the two vector searches share: valid vectors, samples, shards of an index, visits of queries to shards, the nearest.

An index is cut into shards of about ``SHARD_ROWS`` rows that lie together (a distance range of a pivot, leaves of a
tree); what would fill more than one shard by itself is split by row number, so neither alike vectors nor repeated
ids gather in one task.  Every row is shuffled to its one shard, every query only to the shards that it has to visit;
a task streams the queries past the rows of its shard, in batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 65536
LEAST_SHARDS = 16
#: Queries that meet a shard at once, a bound on memory.
ASK_ROWS = 1024
#: Components from here on are no finite numbers to the searches: products of larger ones leave the range of doubles.
LARGEST = 2.0**490


def usable(v: Column, *, allow_zero: bool) -> Column:
    """Not null or empty, without null or non-finite components (or such of ``LARGEST`` or more)."""
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST)))
    return fine if allow_zero else fine & F.exists(v, lambda x: x != 0)


def vectors(table: DataFrame, *, id_col: str, vec_col: str, allow_zero: bool) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and how many: usable, with an id, of the commonest dimension (ties: the larger)."""
    v = F.col(vec_col)
    kept = v if table.schema[vec_col].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    rows = table.where(F.col(id_col).isNotNull() & F.coalesce(usable(v, allow_zero=allow_zero), F.lit(False))).select(F.col(id_col).cast("long").alias("id"), kept.alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (most["d"] if most else 0)), most["count"] if most else 0


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def bounded_sample(rows: DataFrame, count: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of at most count of about total rows, by order of a hash of id and vector; repeated rows count once.

    Whatever the partitions, the sample is the same; a share of the hashes is read first, more only if too few differ.
    """
    share, key = 4 * count / max(1, total), F.xxhash64("id", "v")
    while True:
        part = rows if share >= 1 else rows.where(F.pmod(key, F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
        got = part.select("id", "v").distinct().orderBy(key, "id", "v").limit(count).collect()
        if len(got) == count or share >= 1:
            break
        share *= 16
    return np.array([r["id"] for r in got], dtype=np.int64), np.array([r["v"] for r in got], dtype=np.float64).reshape(len(got), len(got[0]["v"]) if got else 1)


def one_query_each(rows: DataFrame, every: int) -> DataFrame:
    """The queries (id, v, own): rows whose id is divisible by every; of the ``own`` rows that share an id, the smallest vector asks."""
    return rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own"))


def shard_rows(total: int) -> int:
    return max(1, min(SHARD_ROWS, math.ceil(total / LEAST_SHARDS)))


def sub_shard(row: Column, subs: Column) -> Column:
    """Which of subs shards a row of an oversized place goes to, by its number."""
    return F.pmod(F.xxhash64(row), subs).cast("int")


#: What a row of an index or a query carries besides id and v, null where it has no use.
CARRIED = {"place": "int", "dist": "double", "plan": "binary"}


def visits(index: DataFrame, asked: DataFrame, shards: int, prepare: Callable[[pa.Table], object], search: Callable[[object, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """search(prepare(rows of a shard), some of its queries) for each shard; both frames have shard, id, v and some of CARRIED."""

    def shaped(df: DataFrame, asks: int) -> DataFrame:
        more = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in CARRIED.items()]
        return df.select(F.col("shard").cast("int").alias("shard"), F.lit(asks).alias("asks"), "id", "v", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ready = None, [], None
        for b in batches:
            key = b["shard"].to_numpy() * 2 + b["asks"].to_numpy().astype(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])).tolist()
            for a, z in zip(edges[:-1], edges[1:]):
                if z == a:
                    continue
                if key[a] >> 1 != shard:
                    shard, held, ready = key[a] >> 1, [], None
                if key[a] & 1 == 0:
                    held.append(b.slice(a, z - a))
                    continue
                if ready is None and held:
                    ready, held = prepare(pa.Table.from_batches(held)), []
                for k in range(a, z, ASK_ROWS) if ready is not None else ():
                    yield search(ready, b.slice(k, min(ASK_ROWS, z - k)))

    both = shaped(index, 0).unionByName(shaped(asked, 1))
    return both.repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "asks", "place", "dist", "id").mapInArrow(run, schema)


def nearest(found: DataFrame, k: int, *before: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties by before, then to the smaller vec_id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *before, "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class TopK:
    """The k best (score, id) of each of m queries, as they are found."""

    def __init__(self, m: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.row, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, np.int64)
        #: A score that the k-th best is known to reach.
        self.kth = np.full(m, -np.inf) if floor is None else floor.astype(np.float64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        old = np.isin(self.row, row)
        r, s, i = np.concatenate([self.row[old], row]), np.concatenate([self.score[old], score]), np.concatenate([self.id[old], ids])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        first = np.concatenate(([True], r[1:] != r[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        place = np.arange(len(r)) - start
        last = place == self.k - 1
        self.kth[r[last]] = np.maximum(self.kth[r[last]], s[last])
        keep = place < self.k
        self.row = np.concatenate([self.row[~old], r[keep]])
        self.score = np.concatenate([self.score[~old], s[keep]])
        self.id = np.concatenate([self.id[~old], i[keep]])


#: Pairs whose products are summed at once.
PAIRS = 1 << 16


def inner_products(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """q[row] . x[col], each summed from the first component to the last, so that a pair has one score wherever it is met."""
    out = np.empty(len(row))
    for k in range(0, len(row), PAIRS):
        a, b = q[row[k : k + PAIRS]], x[col[k : k + PAIRS]]
        total = np.zeros(len(a))
        for d in range(q.shape[1]):
            total += a[:, d] * b[:, d]
        out[k : k + PAIRS] = total
    return out


def add_nearest(top: TopK, rows: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Adds to top the block (x, ids) for queries q, numbered rows, with ids own; returns the places in the block that got in.

    Fast products choose the candidates, with room for their rounding; the scores that count are ``inner_products``.
    """
    fast = q @ x.T
    slack = 1e-12 * (1 + np.sqrt((q * q).sum(axis=1)) * math.sqrt((x * x).sum(axis=1).max()))
    fast[own[:, None] == ids[None]] = -np.inf
    least = top.kth[rows] - slack
    if x.shape[0] > top.k:
        least = np.maximum(least, np.partition(fast, -top.k, axis=1)[:, -top.k] - 2 * slack)
    r, c = np.nonzero((fast >= least[:, None]) & (fast > -np.inf))
    top.add(rows[r], inner_products(q, x, r, c), ids[c])
    return c
