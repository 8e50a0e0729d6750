"""Exact top-k inner products through a pivot-distance index.

Components become floor(256 x).  Every vector is keyed by its nearest pivot and its distance to it; the index is cut
into shards, each a range of distances of one pivot, and a shard is sorted by distance and cut into annuli.  For a
query, the triangle inequality bounds the distance to all of a shard or annulus from below by how far the query's own
distance to the pivot is outside of it, and so the inner product from above:

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + max |x|^2 - bound^2) / 2

Each query first visits its most promising shard, then only those whose bound reaches its k-th best score so far
(which starts from a bounded sample); in a shard it expands its annuli from the most promising on and stops at the
first whose bound is below that score.  Products from 2**53 on are beyond doubles: there a query is compared with all of
a shard that it visits, and candidates within rounding get whole-number scores.

Defined cases: vectors that are null, empty, of an uncommon dimension, without an id, or with null, non-finite or
larger components than 2**490 take no part; repeated rows are candidates of their own; rows that share an id with a
query are its own and never its candidates, and of them the smallest vector asks; ranks follow the true products,
also beyond 64 bits, where scores are then clipped to that range; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmend.llm.common import checkpointed
from glyphmend.llm.vectors import TopK, bounded_sample, matrix, nearest, one_query_each, shard_rows, sub_shard, vectors, visits

SCALE = 256.0
PIVOTS = 32
#: Rows, by order of a hash, from which pivots and first scores are taken.
SAMPLE = 2048
ANNULUS = 128
#: Steps of distance that a pivot's vectors are counted in; with PIVOTS, a bound on what the driver holds.
BINS = 512
EXACT = float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Bytes that hold any product, shifted to be positive.
WIDE = 136


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal over a sample."""
    if not len(sample):
        return sample
    chosen, least = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if least.max() == 0:
            break
        chosen.append(int(least.argmax()))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _keyed(pivots: np.ndarray):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = np.floor(matrix(b["v"]) * SCALE)
            d = _distances(x, pivots)
            p = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], b["n"], pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p]), pa.array((x * x).sum(axis=1))], names=["id", "v", "n", "place", "dist", "norm"])

    return keyed


@dataclass
class Shards:
    """Shards as arrays: pivot, least and largest distance, largest squared norm; places maps (pivot, bin) to the first of its subs."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray
    places: list[tuple[int, int, int, int]]

    @classmethod
    def of(cls, bins: list, most: int) -> Shards:
        """From (place, bin, rows, low, high, norm) in order; a shard has about most rows."""
        groups: list[list] = []
        for b in bins:
            last = groups[-1] if groups else None
            if last is not None and last[0]["place"] == b["place"] and sum(x["rows"] for x in last) + b["rows"] <= most:
                last.append(b)
            else:
                groups.append([b])
        columns, places = [], []
        for g in groups:
            subs = math.ceil(sum(x["rows"] for x in g) / most)
            places += [(x["place"], x["bin"], len(columns), subs) for x in g]
            columns += [(g[0]["place"], min(x["low"] for x in g), max(x["high"] for x in g), max(x["norm"] for x in g))] * subs
        pivot, low, high, norm = (np.array(c, dtype=np.float64) for c in zip(*columns)) if columns else [np.empty(0)] * 4
        return cls(pivot.astype(np.int64), low, high, norm, places)

    def bounds(self, q: np.ndarray, to_pivot: np.ndarray) -> np.ndarray:
        """What no inner product of a query with a vector of the shard exceeds."""
        return _bounds((q * q).sum(axis=1), to_pivot[:, self.pivot], self.low, self.high, self.norm)


def _bounds(norm: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    apart = np.maximum(0.0, np.maximum(low - d, d - high) - 1e-6 * (1 + d + high + np.sqrt(norm)[:, None] + np.sqrt(most)))
    return (norm[:, None] + most - apart * apart) / 2 + 1e-6 * (1 + norm[:, None]) + 1e-12 * most


def annuli(pivot: np.ndarray, dist: np.ndarray, width: int = ANNULUS) -> list[tuple[int, int]]:
    """Row ranges over vectors sorted by (pivot, dist): one pivot each, width rows at most."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)])).tolist()
    return [(k, min(k + width, z)) for a, z in zip(edges[:-1], edges[1:]) for k in range(a, z, width)]


def _prepare(table: pa.Table) -> dict:
    ids, x, dist = table["id"].to_numpy(), np.floor(matrix(table["v"]) * SCALE), table["dist"].to_numpy()
    rings, norms = annuli(np.zeros(len(ids), dtype=np.int64), dist), (x * x).sum(axis=1)
    return {
        "ids": ids, "x": x, "pivot": table["place"][0].as_py(), "rings": rings, "largest": np.abs(x).max(),
        "low": np.array([dist[a] for a, _ in rings]), "high": np.array([dist[z - 1] for _, z in rings]), "norm": np.array([norms[a:z].max() for a, z in rings]),
    }


def _search(pivots: np.ndarray, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])

    def search(shard: dict, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, x, rings = shard["ids"], shard["x"], shard["rings"]
        qid, q = asked["id"].to_numpy(), np.floor(matrix(asked["v"]) * SCALE)
        if not shard["largest"] * np.abs(q).max() * x.shape[1] < EXACT:
            return _whole_numbers(schema, ids, x, qid, q, k)
        top = TopK(len(q), k, asked["dist"].to_numpy(zero_copy_only=False))
        to_pivot = _distances(q, pivots[shard["pivot"]][None])
        bound = _bounds((q * q).sum(axis=1), to_pivot, shard["low"], shard["high"], shard["norm"])
        path = np.argsort(-bound, axis=1, kind="stable")
        going = np.arange(len(q))
        for step in range(len(rings)):
            ring = path[going, step]
            on = bound[going, ring] >= top.kth[going]
            going, ring = going[on], ring[on]
            if not len(going):
                break
            for a in np.unique(ring).tolist():
                lo, hi = rings[a]
                rows = going[ring == a]
                scores = q[rows] @ x[lo:hi].T
                r, c = np.nonzero((scores >= top.kth[rows][:, None]) & (ids[None, lo:hi] != qid[rows][:, None]))
                top.add(rows[r], scores[r, c], ids[lo:hi][c])
        return pa.RecordBatch.from_arrays([pa.array(qid[top.row]), pa.array(top.id), pa.array(top.score.astype(np.int64)), pa.nulls(len(top.id), pa.binary())], schema=schema)

    return search


def _whole_numbers(schema: pa.Schema, ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of a shard where doubles do not hold the products."""
    rows: list[tuple[int, int, int, bytes | None]] = []
    for i, own in enumerate(qid.tolist()):
        fast = np.where(ids == own, -np.inf, x @ q[i])
        slack = 1e-12 * np.sqrt((q[i] * q[i]).sum()) * np.sqrt((x * x).sum(axis=1).max())
        least = np.partition(fast, -k)[-k] - 2 * slack if len(fast) > k else -np.inf
        ask = [int(c) for c in q[i].tolist()]
        found = [(sum(a * int(b) for a, b in zip(ask, x[j].tolist())), int(ids[j])) for j in np.flatnonzero((fast >= least) & (ids != own)).tolist()]
        for score, j in sorted(found, key=lambda f: (-f[0], f[1]))[:k]:
            rows.append((own, j, min(max(score, LOW), HIGH), (score + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big") if not LOW < score < HIGH else None))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _route(shards: Shards, pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, rest: bool):
    """Adds to each query its floor (dist) and the shards to visit: the most promising, or (rest) all others that its floor lets in."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                qid, q = b["id"].to_numpy(), np.floor(matrix(b["v"]) * SCALE)
                floor = b["dist"].to_numpy(zero_copy_only=False).astype(np.float64)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                if len(sample) >= k:
                    scores = np.where(sample_ids[None] == qid[:, None], -np.inf, q @ sample.T)
                    floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                room = 1e-12 * np.abs(floor) + 1e-12 * np.sqrt((q * q).sum(axis=1)) * math.sqrt(shards.norm.max())
                floor = np.where(np.abs(floor) < EXACT / 2, floor, floor - np.where(np.isfinite(floor), room, 0.0))
                bound = shards.bounds(q, _distances(q, pivots))
                best = bound.argmax(axis=1)
                if rest:
                    go = bound >= floor[:, None]
                    go[np.arange(len(q)), best] = False
                    to = [np.flatnonzero(g).tolist() for g in go]
                else:
                    to = best[:, None].tolist()
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(floor), pa.array(to, pa.list_(pa.int32()))], names=["id", "v", "dist", "shards"])

    return route


def exact_top_k(table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, shard: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products for each row whose id is divisible by every."""
    spark = table.sparkSession
    rows, total = vectors(table, id_col=id_col, vec_col=vec_col, allow_zero=True)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = rows.schema["v"].dataType.simpleString()
    sample_ids, first = bounded_sample(rows, sample, total)
    first = np.floor(first * SCALE)
    marks = choose_pivots(first, pivots)
    keyed = checkpointed(rows.withColumn("n", F.monotonically_increasing_id()).mapInArrow(_keyed(marks), f"id long, v {kind}, n long, place int, dist double, norm double"))
    # At most BINS rows a pivot come to the driver, and go out again as a table to join with.
    reach = F.broadcast(keyed.groupBy("place").agg(F.max("dist").alias("reach")))
    binned = keyed.join(reach, "place").withColumn("bin", F.least(F.lit(BINS - 1), F.coalesce(F.try_divide(F.col("dist") * BINS, F.col("reach")), F.lit(0.0)).cast("int")))
    counts = binned.groupBy("place", "bin").agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm"))
    shards = Shards.of(sorted(counts.collect(), key=lambda r: (r["place"], r["bin"])), shard or shard_rows(total))
    places = F.broadcast(spark.createDataFrame(shards.places, "place int, bin int, first int, subs int"))
    index = binned.join(places, ["place", "bin"]).withColumn("shard", F.col("first") + sub_shard(F.col("n"), F.col("subs")))
    queries = one_query_each(rows, every)

    def asked(floors: DataFrame, rest: bool) -> DataFrame:
        routed = floors.select("id", "v", "dist").mapInArrow(_route(shards, marks, sample_ids, first, k, rest), f"id long, v {kind}, dist double, shards array<int>")
        return routed.withColumn("shard", F.explode("shards"))

    schema = "query_id long, vec_id long, score long, beyond binary"
    at_home = checkpointed(visits(index, asked(queries.withColumn("dist", F.lit(None).cast("double")), False), len(shards.pivot), _prepare, _search(marks, k), schema))
    # The k-th best at home bounds all others; one at the lower end of 64 bits says nothing.
    kth = at_home.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found")).where((F.col("found") >= k) & (F.col("least") > LOW))
    floors = queries.join(kth.select(F.col("query_id").alias("id"), F.col("least").cast("double").alias("dist")), "id", "left")
    elsewhere = visits(index, asked(floors, True), len(shards.pivot), _prepare, _search(marks, k), schema)
    return nearest(at_home.unionByName(elsewhere), k, F.col("beyond").desc_nulls_last())
