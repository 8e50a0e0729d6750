"""Near copies by the rule of the pipeline: a Jaccard similarity of 0.8 or more over five-word shingles.

The method is that of ``simhash``, fingerprints in a vantage-point tree with overlapping shards, with the fingerprints
that this rule needs and an exact check after it:

1. Fingerprints: ``BITS`` * ``TREES`` + 256 majority bits of a text's shingles.  A bit of two texts of similarity 0.8
   differs with a probability of 0.152, so 64 bits have no radius for the rule: such texts lie about 10 bits apart and
   up to 20, where the band of a tree holds everything.  ``TREES`` fingerprints of ``BITS`` bits have one: such texts
   are within ``RADIUS`` in each with a probability of 0.28, in one of them at least with 0.9998 (0.9: over 0.99999).
2. Distinct texts alone go on (a group of exact copies is one row, however large).
3. Each of the ``TREES`` fingerprints has a tree, fitted on a bounded sample; texts within ``RADIUS`` always meet in a
   shard, by the triangle inequality.  A shard's distinct fingerprints are split further by the same rule, small sets
   are compared, and texts within ``RADIUS`` are candidates if the other 256 bits are near as well (0.9999 of those of
   similarity 0.8 are).  A union-find keeps one link a text; components of the links are clusters.
4. In a cluster all texts are compared by their whole shingles, so no fingerprint decides.  Clusters of over ``PAIRED``
   texts are dealt into blocks, and each pair of blocks is a task's: of g texts each goes to about (g / PAIRED) ** 0.5
   tasks.  A union-find keeps one link a text again; components of these links are the groups.

Bounds: the trees (``SAMPLE`` fingerprints at most) are the only thing on the driver.

Defined cases: words are those of ``simhash``; fewer words than a shingle are one shingle; null and empty texts
are copies of one another; very long texts are read whole, their shingles in pieces; ids and repeated rows as there;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmend.llm.common import checkpointed
from glyphmend.llm.components import components
from glyphmend.llm.simhash import SEED, Tree, _distance, _find, _union, grouped

SHINGLE = 5
#: The least similarity of near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Fingerprints with a tree each, and their bits.
TREES, BITS = 26, 16
#: Bits beside them by which candidates are checked, and how many may differ.
CHECKED, APART = 256, 60
#: Fingerprints, taken by order of a hash, on which the trees are fitted.
SAMPLE = 1 << 13
#: Fingerprints that a shard should hold.
SHARD = 1 << 17
#: Bits that candidates may differ by in one of the fingerprints.
RADIUS = 1
#: A set of a shard's distinct fingerprints up to this size is compared directly.
LEAF = 512
#: Commonest values of a shard that have over ``DENSE`` texts: all texts are compared with one of each first.
PIVOTS, DENSE = 8, 64
#: Texts of a cluster that one task compares with each other.
PAIRED = 64
#: Bytes of text that a block should hold.
BLOCK = 1 << 23
#: Shingles whose weights are summed at once: as many bytes fit 16 bits.
CHUNK = 1 << 8
MIX = np.uint64(0x9E3779B97F4A7C15)
LANES = np.uint64(0x00FF00FF00FF00FF)

_random = np.random.default_rng(SEED)
TIMES = _random.integers(0, 1 << 63, (TREES * BITS + CHECKED) // 8, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
PLUS = _random.integers(0, 1 << 63, len(TIMES), dtype=np.uint64)
SIGNATURE = np.dtype([("tree", "<u2", TREES), ("checked", "<u8", CHECKED // 64)])
ENTRY = np.dtype([("fp", "<u2"), ("node", "<i8"), ("checked", "<u8", CHECKED // 64)])


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), dtype=np.uint64, count=len(words))
    n = len(words) - shingle + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(shingle):
        h = (h ^ w[k : k + n]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """The fingerprints of a text by its shingles, one SIGNATURE: a bit is set if the bytes that the shingles draw for it are large."""
    total = np.zeros(8 * len(TIMES), dtype=np.int64)
    for k in range(0, len(h), CHUNK):
        drawn = h[k : k + CHUNK, None] * TIMES + PLUS
        drawn = (drawn ^ drawn >> np.uint64(32)) * MIX
        low, high = (drawn & LANES).sum(axis=0), (drawn >> np.uint64(8) & LANES).sum(axis=0)
        total += np.concatenate([low, high]).view(np.uint16)
    bits = (2 * total > 255 * len(h)).astype(np.uint8)
    out = np.zeros((), dtype=SIGNATURE)
    out["tree"] = np.packbits(bits[: TREES * BITS]).view("<u2")
    out["checked"] = np.packbits(bits[TREES * BITS :]).view("<u8")
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b["_text"].to_pylist()
        signed = pa.array([signature(shingles(t)).tobytes() for t in texts], pa.binary())
        sizes = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b["id"], b["text_hash"], sizes, signed], names=["id", "text_hash", "bytes", "signature"])


def near_values(values: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j), i <= j, of all values within RADIUS of each other, themselves included, by a vantage-point tree."""
    out, todo = [np.arange(len(values), dtype=np.int64) * (len(values) + 1)], [(np.arange(len(values)), 0)]
    while todo:
        rows, depth = todo.pop()
        x = values[rows]
        if len(rows) > leaf and depth < 60:
            d = _distance(x, x[(depth * 7919) % len(x)]).astype(np.int16)
            m = int(np.median(d))
            inside, outside = rows[d <= m], rows[d > m - RADIUS]
            if max(len(inside), len(outside)) <= 0.9 * len(rows):
                todo += [(inside, depth + 1), (outside, depth + 1)]
                continue
        step = max(1, (1 << 18) // max(1, len(x)))
        for k in range(0, len(x), step):
            i, j = np.divmod(np.flatnonzero(_distance(x[k : k + step, None], x[None, k:]) <= RADIUS), len(x) - k)
            i, j = i[i < j], j[i < j]
            out.append(rows[i + k] * len(values) + rows[j + k])
    # A pair meets in several sets of the band.
    return np.divmod(np.unique(np.concatenate(out)), max(1, len(values)))


def _products(first: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members (those of k are sizes[k] places from first[k]) of i[k] and j[k], about most at once."""
    step = np.maximum(1, most // sizes[j])
    pieces = -(-sizes[i] // step)
    k = np.repeat(np.arange(len(i)), pieces)
    skip = (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step[k]
    left, right, across = first[i[k]] + skip, first[j[k]], sizes[j[k]]
    made = np.minimum(step[k], sizes[i[k]] - skip) * across
    cuts = np.unique(np.concatenate(([0], np.searchsorted(np.cumsum(made), np.arange(most, made.sum(), most)), [len(k)])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        pair = np.repeat(np.arange(a, b), made[a:b])
        at = np.arange(len(pair)) - np.repeat(np.cumsum(made[a:b]) - made[a:b], made[a:b])
        x, y = np.divmod(at, across[pair])
        yield left[pair] + x, right[pair] + y


def candidates(entries: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(node, node) links that join the candidates among the ENTRY rows of a shard."""
    entries = entries[np.argsort(entries["fp"], kind="stable")]
    fps, checked, parent = entries["fp"], np.ascontiguousarray(entries["checked"]), np.arange(len(entries))
    values, first, sizes = np.unique(fps, return_index=True, return_counts=True)
    # Of a dense group all are joined with a member of its commonest value first: what is joined is not paired below.
    for v in np.argsort(-sizes, kind="stable")[:PIVOTS]:
        if sizes[v] > DENSE:
            near = np.flatnonzero(_distance(checked, checked[first[v]]).sum(axis=1) <= APART)
            _union(parent, np.full(len(near), first[v]), near)
    label = np.array([_find(parent, r) for r in range(len(entries))], dtype=np.int64)
    order = np.lexsort((label, fps))
    fps, label, checked = fps[order], label[order], checked[order]
    # Runs are rows of one value that are joined already; those of two near values are paired unless they are joined too.
    begins = np.flatnonzero(np.concatenate(([True], (fps[1:] != fps[:-1]) | (label[1:] != label[:-1]))))
    lengths = np.diff(np.append(begins, len(fps)))
    _, runs, many = np.unique(fps[begins], return_index=True, return_counts=True)
    for x, y in _products(runs, many, *near_values(values, leaf), 1 << 20):
        apart = (label[begins[x]] != label[begins[y]]) & ((x < y) | (fps[begins[x]] != fps[begins[y]]))
        for i, j in _products(begins, lengths, x[apart], y[apart], 1 << 18):
            d = _distance(checked[i, 0], checked[j, 0])
            for w in range(1, checked.shape[1]):
                # Most pairs are far before the last word: the others alone are read on.
                near = d <= APART
                i, j, d = i[near], j[near], d[near]
                d = d.astype(np.int16) + _distance(checked[i, w], checked[j, w])
            near = d <= APART
            if near.any():
                _union(parent, order[i[near]], order[j[near]])
    roots = np.array([_find(parent, r) for r in range(len(entries))], dtype=np.int64)
    linked = np.flatnonzero(roots != np.arange(len(entries)))
    return entries["node"][roots[linked]], entries["node"][linked]


def _shard_candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = candidates(np.concatenate([np.frombuffer(p, ENTRY) for p in pdf["pack"]]))
    return pd.DataFrame({"a": a, "b": b})


def candidate_links(distinct: DataFrame, *, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between texts (rows fp, signature of distinct) whose fingerprints are near, enough of them to join all that are."""
    total = distinct.count()
    rows = distinct.select("signature").orderBy(F.xxhash64("fp")).limit(sample).collect()
    drawn = np.frombuffer(b"".join(r["signature"] for r in rows), SIGNATURE)["tree"]
    trees = [Tree.fit(np.ascontiguousarray(drawn[:, t]), total, radius=RADIUS, shard=shard) for t in range(TREES)]
    first = np.cumsum([0] + [t.shards for t in trees]).tolist()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = np.frombuffer(b"".join(b["signature"].to_pylist()), SIGNATURE)
            entries, keys, packs = np.zeros(len(signed), dtype=ENTRY), [], []
            entries["node"], entries["checked"] = b["fp"].to_numpy(zero_copy_only=False), signed["checked"]
            for t, tree in enumerate(trees):
                entries["fp"] = signed["tree"][:, t]
                shards, places = tree.deal(entries["fp"], RADIUS)
                for s in np.unique(shards).tolist():
                    keys.append(first[t] + s)
                    packs.append(entries[places[shards == s]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packs, pa.binary())], names=["shard", "pack"])

    dealt = distinct.select("fp", "signature").mapInArrow(deal, "shard int, pack binary")
    return dealt.groupBy("shard").applyInPandas(_shard_candidates, "a long, b long")


def similar_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Links between places of sets that join all of left and right that are similar enough to one of the other side."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    those, stops = np.concatenate([own[k] for k in right]), np.cumsum(sizes[right])
    starts, marked, label, a, b = stops - sizes[right], np.zeros(len(words), dtype=np.int32), np.arange(len(sets)), [], []
    for k in left.tolist():
        marked[own[k]] = 1
        sums = np.concatenate(([0], np.cumsum(marked[those])))
        marked[own[k]] = 0
        both = sums[stops] - sums[starts]
        hits = right[SIMILAR[1] * both >= SIMILAR[0] * (sizes[k] + sizes[right] - both)]
        joined, at = np.unique(label[hits], return_index=True)
        at, joined = at[joined != label[k]], joined[joined != label[k]]
        if len(at):
            a += [k] * len(at)
            b += hits[at].tolist()
            label[np.isin(label, joined)] = label[k]
    return a, b


def _verified(key: tuple, group: pa.Table) -> pa.Table:
    """Links of a pair of blocks (of a cluster, or of the clusters of a bucket)."""
    _, i, j = (k.as_py() for k in key)
    cluster, block, node = (group[c].to_numpy() for c in ("cluster", "block", "node"))
    sets, a, b = [shingles(t) for t in group["text"].to_pylist()], [], []
    for c in np.unique(cluster):
        here = np.flatnonzero(cluster == c)
        left, right = (np.flatnonzero(block[here] == k) for k in (i, j))
        if len(left) and len(right):
            x, y = similar_links([sets[k] for k in here], left, right)
            a += node[here[x]].tolist()
            b += node[here[y]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def copy_links(distinct: DataFrame, docs: DataFrame, *, text_col: str, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) that join the texts (rows fp, signature, bytes of distinct) that are similar enough."""
    clusters = components(candidate_links(distinct)).join(distinct.select(F.col("fp").alias("node"), "bytes"), "node")
    clusters = checkpointed(clusters.select("node", F.col("root").alias("cluster"), "bytes"))
    texts, size = clusters.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = 1 + max(texts // (4 * paired), size // BLOCK)
    many = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    many = many.select("cluster", F.greatest(F.ceil(F.sqrt(F.col("n") / paired)), F.ceil(F.col("size") / BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    placed = clusters.join(many, "cluster", "left").select("node", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    part = F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets))).alias("part")
    whole = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text")).dropDuplicates(["node"])
    rows = whole.join(placed.select("node", "cluster", block, part, "blocks"), "node")
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cluster", "block", "node", "text")
    return dealt.groupBy("part", "i", "j").applyInArrow(_verified, "a long, b long")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b["text"].to_pylist()]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b["node"], pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["node", "shingles"])


def rarest(texts: DataFrame) -> DataFrame:
    """node, n (its shingles), shingle, nth: of each of texts (node, text), the rarest shingles, one of which every similar text has."""
    rows = checkpointed(texts.select("node", "text").mapInArrow(_shingled, "node long, shingles array<long>"))
    each = rows.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    seen = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("node").orderBy("seen", "shingle")
    needed = F.col("n") - F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]) + 1
    return each.join(seen, "shingle").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= needed).select("node", "n", "shingle", "nth")


def near_copies(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", paired: int = PAIRED) -> DataFrame:
    """id, text_hash, fp (the same), component_fp (one for each group), component_id (smallest id of the group) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    signed = rows.mapInArrow(_signatures, f"id {kind}, text_hash long, bytes long, signature binary")
    signed = checkpointed(signed.withColumn("fp", F.col("text_hash")))
    distinct = checkpointed(signed.groupBy("fp").agg(F.min("id").alias("least"), F.first("bytes").alias("bytes"), F.first("signature").alias("signature")))
    return grouped(signed, distinct, copy_links(distinct, docs, text_col=text_col, paired=paired), id_col=id_col)
