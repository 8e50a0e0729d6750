"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

The tree (two levels) is fitted on a bounded sample and indexes every row: a vector descends to the
nearest centroid at each level.  A query walks the tree through a priority queue of nodes, ordered by
inner product with their centroids, and visits leaves until a number of visits that calibration has
found: for a bounded set of the queries, the true neighbours among all rows are computed, and visits
are widened until ``RECALL`` of them lie in visited leaves.  Leaves that lie together share a shard; a leaf
of more rows than a shard is split by row number.  A query goes to the shards of its leaves alone.

Scores are summed from the first component to the last, so equal tables give equal results however they are
partitioned.

Defined cases: vectors that are null, empty, zero, of an uncommon dimension, without an id, or with
null, non-finite or larger components than 2**490 take no part; repeated rows are candidates of their own; rows that
share an id with a query are its own and never its candidates, and of them the smallest vector asks; ties go to the
smaller id; queries with few candidates in visited leaves visit more until they have k or all; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmend.llm.common import checkpointed
from glyphmend.llm.vectors import TopK, add_nearest, bounded_sample, matrix, nearest, one_query_each, shard_rows, sub_shard, vectors, visits

#: Rows, by order of a hash, on which the tree is fitted.
SAMPLE = 16384
BRANCHES = 16
ROWS_PER_LEAF = 32
#: Queries whose true neighbours calibrate the number of visits.
CALIBRATION = 128
RECALL = 0.95


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * x @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)


def kmeans(x: np.ndarray, count: int, *, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from a spread-out start."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(x)))
    centres = [x[int(rng.integers(len(x)))]]
    least = np.full(len(x), np.inf)
    while len(centres) < count:
        least = np.minimum(least, ((x - centres[-1]) ** 2).sum(axis=1))
        total = least.sum()
        if not total > 0:
            break
        centres.append(x[min(len(x) - 1, int(np.searchsorted(np.cumsum(least), rng.random() * total)))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = _assign(x, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


@dataclass
class Tree:
    """Upper centroids, leaf centroids, and for each upper node the numbers of its leaves."""

    upper: np.ndarray
    leaves: np.ndarray
    of: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, branches: int = BRANCHES) -> Tree:
        branches = max(1, min(branches, math.isqrt(max(1, len(sample) // ROWS_PER_LEAF))))
        upper = kmeans(sample, branches)
        own, leaves, of, count = _assign(sample, upper), [], [], 0
        for j in range(len(upper)):
            part = sample[own == j]
            centres = kmeans(part, branches, seed=2 + j) if len(part) else upper[j : j + 1]
            leaves.append(centres)
            of.append(np.arange(count, count + len(centres)))
            count += len(centres)
        return cls(upper, np.concatenate(leaves), of)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, own = np.empty(len(x), dtype=np.int32), _assign(x, self.upper)
        for j in np.unique(own).tolist():
            rows = np.flatnonzero(own == j)
            out[rows] = self.of[j][_assign(x[rows], self.leaves[self.of[j]])]
        return out

    def walk(self, upper_scores: list[float], leaf_scores: list[float]) -> Iterator[int]:
        """Leaves, best bin first, for a query's inner products with all centroids."""
        queue = [(-s, 0, j) for j, s in enumerate(upper_scores)]
        heapq.heapify(queue)
        while queue:
            _, leaf, j = heapq.heappop(queue)
            if leaf:
                yield j
            else:
                for i in self.of[j].tolist():
                    heapq.heappush(queue, (-leaf_scores[i], 1, i))

    def walks(self, q: np.ndarray) -> Iterator[Iterator[int]]:
        for a, b in zip((q @ self.upper.T).tolist(), (q @ self.leaves.T).tolist()):
            yield self.walk(a, b)


def _indexed(tree: Tree):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], b["n"], pa.array(tree.leaf_of(matrix(b["v"])))], names=["id", "v", "n", "place"])

    return indexed


def leaf_shards(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of each leaf: neighbours share a shard while it has about most rows, larger leaves get several."""
    first, subs, at, held = np.zeros(len(sizes), dtype=np.int32), np.ones(len(sizes), dtype=np.int32), 0, 0
    for j, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            at, held = at + 1, 0
        first[j], held = at, held + n
        if n > most:
            subs[j] = math.ceil(n / most)
            at, held = at + int(subs[j]), 0
    return first, subs


def _planned(tree: Tree, visited: int, sizes: np.ndarray, first: np.ndarray, subs: np.ndarray, k: int):
    """Adds to each query a bitmap of the leaves that it visits, and their shards."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            plans, shards = [], []
            for walk, own in zip(tree.walks(matrix(b["v"])), b["own"].to_pylist()):
                seen, rows = np.zeros(len(tree.leaves), dtype=bool), 0
                for n, leaf in enumerate(walk):
                    if n >= visited and rows >= k + own:
                        break
                    seen[leaf] = True
                    rows += sizes[leaf]
                plans.append(np.packbits(seen).tobytes())
                shards.append(sorted({s for j in np.flatnonzero(seen & (sizes > 0)).tolist() for s in range(first[j], first[j] + subs[j])}))
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(plans, pa.binary()), pa.array(shards, pa.list_(pa.int32()))], names=["id", "v", "plan", "shards"])

    return planned


def _prepare(leaves: int):
    def prepare(table: pa.Table) -> tuple:
        leaf = table["place"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        return table["id"].to_numpy()[order], matrix(table["v"])[order], np.searchsorted(leaf[order], np.arange(leaves + 1))

    return prepare


def _search(leaves: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(shard: tuple, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, x, edges = shard
        qid, q = asked["id"].to_numpy(), matrix(asked["v"])
        plan = np.unpackbits(np.frombuffer(b"".join(asked["plan"].to_pylist()), dtype=np.uint8).reshape(len(q), -1), axis=1)[:, :leaves].astype(bool)
        top = TopK(len(q), k)
        for j in np.flatnonzero(np.diff(edges)).tolist():
            visitors = np.flatnonzero(plan[:, j])
            for at in range(edges[j], edges[j + 1] if len(visitors) else 0, 4096):
                to = min(at + 4096, edges[j + 1])
                add_nearest(top, visitors, q[visitors], qid[visitors], x[at:to], ids[at:to])
        return pa.RecordBatch.from_arrays([pa.array(qid[top.row]), pa.array(top.id), pa.array(top.score)], schema=schema)

    return search


def _true_leaves(qid: np.ndarray, q: np.ndarray, k: int):
    """Candidates for the k nearest of the calibration queries in each task, with their leaves."""

    def true_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(len(q), k)
        leaf_by_id: dict[int, int] = {}
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.slice(at, 4096)
                ids, leaf = b["id"].to_numpy(), b["place"].to_numpy()
                c = np.unique(add_nearest(top, np.arange(len(q)), q, qid, matrix(b["v"]), ids))
                leaf_by_id.update(zip(ids[c].tolist(), leaf[c].tolist()))
        if len(top.row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid[top.row]), pa.array(top.id), pa.array(top.score), pa.array([leaf_by_id[i] for i in top.id.tolist()], pa.int32())], names=["query_id", "vec_id", "score", "leaf"]
            )

    return true_leaves


def calibrate(index: DataFrame, queries: DataFrame, tree: Tree, *, asked: int, k: int, recall: float = RECALL, count: int = CALIBRATION) -> tuple[int, float]:
    """(visits, recall reached) on at most count of the asked queries, against all rows."""
    qid, q = bounded_sample(queries, count, asked)
    if not len(q):
        return 1, 1.0
    found = index.mapInArrow(_true_leaves(qid, q, k), "query_id long, vec_id long, score double, leaf int")
    best = nearest(found.withColumn("vec_id", F.struct("vec_id", "leaf")), k).select("query_id", "vec_id.leaf").collect()
    want: dict[int, list[int]] = {}
    for r in best:
        want.setdefault(r["query_id"], []).append(r["leaf"])
    place = []
    for i, walk in zip(qid.tolist(), tree.walks(q)):
        nth = {leaf: n for n, leaf in enumerate(walk)}
        place += [nth[leaf] for leaf in want.get(i, [])]
    visited, place = 1, np.array(place)
    while visited < len(tree.leaves) and len(place) and (place < visited).mean() < recall:
        visited += max(1, visited // 8)
    return min(visited, len(tree.leaves)), float((place < visited).mean()) if len(place) else 1.0


def approximate_neighbours(table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, sample: int = SAMPLE, recall: float = RECALL, shard: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose id is divisible by every, and the calibrated leaf_visits and recall."""
    rows, total = vectors(table, id_col=id_col, vec_col=vec_col, allow_zero=False)
    kind = rows.schema["v"].dataType.simpleString()
    _, fitted = bounded_sample(rows, sample, total)
    tree = Tree.fit(fitted if len(fitted) else np.zeros((1, 1)))
    index = checkpointed(rows.withColumn("n", F.monotonically_increasing_id()).mapInArrow(_indexed(tree), f"id long, v {kind}, n long, place int"))
    queries = checkpointed(one_query_each(rows, every))
    # One row a leaf: bounded by the tree.
    counts = {r["place"]: r["count"] for r in index.groupBy("place").count().collect()}
    sizes = np.array([counts.get(j, 0) for j in range(len(tree.leaves))])
    first, subs = leaf_shards(sizes, shard or shard_rows(total))
    visited, reached = calibrate(index, queries, tree, asked=queries.count(), k=k, recall=recall)
    planned = queries.mapInArrow(_planned(tree, visited, sizes, first, subs, k), f"id long, v {kind}, plan binary, shards array<int>")
    asked = planned.withColumn("shard", F.explode("shards"))
    places = F.broadcast(table.sparkSession.createDataFrame([(j, int(a), int(n)) for j, (a, n) in enumerate(zip(first, subs))], "place int, first int, subs int"))
    placed = index.join(places, "place").withColumn("shard", F.col("first") + sub_shard(F.col("n"), F.col("subs")))
    found = visits(placed, asked, int((first + subs).max()), _prepare(len(tree.leaves)), _search(len(tree.leaves), k), "query_id long, vec_id long, score double")
    return nearest(found, k).withColumns({"leaf_visits": F.lit(visited), "calibrated_recall": F.lit(reached)})
