"""SimHash near duplicates through a vantage-point tree over 64-bit fingerprints.

1. Fingerprints: majority bits of the XXH64 of all word shingles of the whole text.
2. Distinct fingerprints alone go on (a group of copies is one row, however large).
3. A tree of vantage points and radii is fitted on a bounded sample.  At a node with vantage v and
   radius m, a fingerprint x goes inside if d(v, x) <= m and outside if d(v, x) > m - r; the band in
   between goes to both shards.  By the triangle inequality two fingerprints within r always meet
   in a shard, so the shards together find every pair; a pair is compared nowhere else.
4. In a shard, oversized sets are split further by the same rule; small ones are compared by XOR and
   bit count, and a union-find keeps one link a fingerprint (never all pairs of a dense group).
5. Components of those links, by distributed star contraction, give each group its smallest id.

Bounds: the tree (``SAMPLE`` rows at most) is the only thing on the driver.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than
a shingle: the whole sequence is hashed; very long texts are read whole, their shingles in pieces; a bit set in just
half of the shingles is 0; repeated rows and ids stay rows of their own; null ids never
name a group while another id is there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmend.llm.common import checkpointed, unpacked, whole_row
from glyphmend.llm.components import components

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints, taken by order of a hash, on which the tree is fitted.
SAMPLE = 1 << 15
#: Fingerprints that a shard should hold; the tree is grown to this where the sample allows.
SHARD = 8192
#: A set up to this size is compared directly.
LEAF = 1024
#: Shingles hashed at once, a bound on memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(starts), CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.array([fingerprint(t) for t in b["_text"].to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], b["text_hash"], pa.array(h)], names=["id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, text_hash (xxhash64 of the text), fp (the 64 bits as a signed long) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_fingerprints, f"id {kind}, text_hash long, fp long")


def _distance(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b))


class Tree:
    """Nodes as arrays: vantage, radius, and the numbers of the inner and outer child (below 0: shard -1 - n)."""

    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.shards = 0

    def _shard(self) -> int:
        self.shards += 1
        return -self.shards

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, *, radius: int = RADIUS, shard: int = SHARD, least: int = 24) -> Tree:
        """A tree whose shards hold about ``shard`` of ``total`` fingerprints, by an even sample of them."""
        tree, scale = cls(), max(1.0, total / max(1, len(sample)))

        def grow(part: np.ndarray, depth: int) -> int:
            if len(part) * scale <= shard or len(part) <= least or depth >= 40:
                return tree._shard()
            best = None
            for v in part[:: max(1, len(part) // 5)][:5]:
                d = _distance(part, v)
                m = int(np.median(d))
                for radius_here in (m - 1, m):
                    inside, outside = part[d <= radius_here], part[d > radius_here - radius]
                    cost = max(len(inside), len(outside)) + 0.5 * (len(inside) + len(outside) - len(part))
                    if best is None or cost < best[0]:
                        best = (cost, v, radius_here, inside, outside)
            _, v, m, inside, outside = best
            if max(len(inside), len(outside)) > 0.95 * len(part):
                return tree._shard()
            at = len(tree.nodes)
            tree.nodes.append([v, m, 0, 0])
            tree.nodes[at][2:] = grow(inside, depth + 1), grow(outside, depth + 1)
            return at

        tree.root = grow(sample, 0)
        return tree

    def deal(self, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(shard, position in fps) of every copy."""
        shards, places, todo = [], [], [(self.root, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                shards.append(np.full(len(rows), -node - 1, dtype=np.int32))
                places.append(rows)
                continue
            v, m, inner, outer = self.nodes[node]
            d = _distance(fps[rows], v).astype(np.int16)
            todo += [(inner, rows[d <= m]), (outer, rows[d > m - radius])]
        if not shards:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(shards), np.concatenate(places)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[k] and b[k], after contracting the pairs to one star a set."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            break
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    for x, y in zip(nodes.tolist(), nodes[label].tolist()):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def local_links(fps: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smallest fp linked to it in this set) for each of the distinct, sorted fps that has a link."""
    parent = np.arange(len(fps))
    todo = [(np.arange(len(fps)), 0)]
    while todo:
        rows, depth = todo.pop()
        x = fps[rows]
        if len(rows) > leaf and depth < 60:
            v = x[(depth * 7919) % len(x)]
            d = _distance(x, v).astype(np.int16)
            m = int(np.median(d))
            inside, outside = rows[d <= m], rows[d > m - radius]
            if max(len(inside), len(outside)) <= 0.9 * len(rows):
                todo += [(inside, depth + 1), (outside, depth + 1)]
                continue
        step = max(1, (1 << 21) // max(1, len(x)))
        for k in range(0, len(x), step):
            part = x[k : k + step]
            i, j = np.nonzero(_distance(part[:, None], x[None, k:]) <= radius)
            apart = i < j
            _union(parent, rows[i[apart] + k], rows[j[apart] + k])
    roots = np.array([_find(parent, i) for i in range(len(fps))], dtype=np.int64) if len(fps) else parent
    linked = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[linked], fps[roots[linked]]


def _shard_links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    fps = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
    a, b = local_links(fps)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def fingerprint_links(distinct: DataFrame, *, sample: int = SAMPLE, shard: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``radius`` of each other, from distinct fp rows."""
    total = distinct.count()
    rows = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(sample).collect()
    tree = Tree.fit(np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64), total, radius=radius, shard=shard)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            shards, places = tree.deal(fps.view(np.uint64), radius)
            yield pd.DataFrame({"shard": shards, "fp": fps[places]})

    dealt = distinct.select("fp").mapInPandas(deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInPandas(_shard_links, "a long, b long")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """id, text_hash, fp, component_fp (one for each group), component_id (smallest id of the group) for each row."""
    marked = checkpointed(fingerprints(docs, text_col=text_col, id_col=id_col))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    return grouped(marked, distinct, fingerprint_links(distinct, sample=sample, shard=shard), id_col=id_col)


def grouped(marked: DataFrame, distinct: DataFrame, links: DataFrame, *, id_col: str) -> DataFrame:
    """The rows of marked (id, text_hash, fp) with the group of their fp by links between the fp of distinct (fp, least)."""
    joined = components(links)
    groups = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("component_fp"))
    heads = groups.groupBy(F.col("component_fp").alias("head")).agg(F.min("least").alias("component_id"))
    named = groups.join(heads, F.col("component_fp") == F.col("head")).select(F.col("fp").alias("nfp"), "component_fp", "component_id")
    return marked.join(named, F.col("fp") == F.col("nfp")).select(F.col("id").alias(id_col), "text_hash", "fp", "component_fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """The columns of docs for one row of each group that find names: that of the smallest id (of repeated rows, one)."""
    found = find(docs, text_col=text_col, id_col=id_col, **options)
    heads = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("component_fp").agg(F.min("text_hash").alias("_khash"), F.first("component_id").alias("_kid"))
    rows = docs.select(whole_row(docs), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    kept = rows.join(heads, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_hash") == F.col("_khash")), "left_semi")
    return kept.dropDuplicates(["_id", "_hash"]).select(*unpacked(docs.columns))
