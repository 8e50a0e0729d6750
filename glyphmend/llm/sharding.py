"""Sharding by a minimax contiguous partition of atomic groups.

Rows are ordered by (group, sub-run, id); a group (here: equal texts) is atomic.  The smallest
shard capacity is found by binary search, each candidate checked greedily over the ordered group
sizes, and the cuts are made there.  The driver never holds the groups, but contiguous segments of the
key range: 4,096 at first, and at most ``SEGMENTS`` more a round.  Cuts that fall into a segment of several
groups bound the capacity from both sides; those segments alone are split finer, by one digit a round, until
no segment that a cut can touch holds more than one group, which makes the answer exact.  As keys are digests, a
digit or two after the first three are enough.  Where one
group alone sets the capacity it has a shard of its own, and the stretches before and after it are
partitioned in the same way over the other shards, so that they stay near equal below it.

Rows equal in id and text are one row with a count, and a group's rows are numbered in sub-runs of about ``SUB_ROWS``,
so neither a repeated row nor a text in a third of the table is one task's work.

Defined cases: null texts are one group, first in order, of size 8 a row; empty texts are another;
repeated rows share a group and have slots of their own; very long texts are read whole; an empty table gives an
empty result; null ids come first in a group.  Fewer groups than shards leave shards empty.  Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmend.llm.common import checkpointed

#: Rows that a sub-run of a group (by hash of the id) should hold, and the least number of sub-runs.
SUB_ROWS, SUBS = 1 << 16, 64
#: Copies of a row that one row of the last step stands for at most.
CHUNK = 1 << 12
#: Most segments that one look at the groups brings to the driver.
SEGMENTS = 1 << 14
ROW_BYTES = 8


@dataclass(frozen=True)
class Segment:
    """Consecutive groups: the prefix of their keys, total size, how many, rows."""

    prefix: str
    size: int
    groups: int


def _greedy(segments: list[Segment], prefix_sums: list[int], capacity: int, shards: int, fluid: bool) -> list[int] | None:
    """Positions (in size) of the cuts if ``shards`` shards of ``capacity`` hold all, else None.

    fluid: segments of several groups may be cut anywhere, a bound that no real partition beats.
    """
    cuts, at, total = [], 0, prefix_sums[-1]
    for _ in range(shards):
        if at >= total:
            break
        reach = at + capacity
        i = bisect.bisect_right(prefix_sums, reach) - 1
        nxt = prefix_sums[i]
        if fluid and i < len(segments) and segments[i].groups > 1:
            nxt = reach
        if nxt <= at:
            return None
        at = min(nxt, total)
        cuts.append(at)
    return cuts if at >= total else None


def _least(segments: list[Segment], sums: list[int], shards: int, fluid: bool, low: int) -> int:
    low, high = low, sums[-1]
    while low < high:
        mid = (low + high) // 2
        if _greedy(segments, sums, mid, shards, fluid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int, *, key: str = "_key", size: str = "_gsize", segments: int = SEGMENTS) -> tuple[list[str], int]:
    """First keys of shards 1, 2, ... and the least capacity, over (key, size) rows with hex keys in order.

    groups should be cheap to read again (checkpointed): each round reads it once.
    """
    digits = 3

    def look(prefixes: list[str] | None, width: int) -> list[Segment]:
        part = groups
        if prefixes is not None:
            old = len(prefixes[0])
            part = part.where(F.substring(key, 1, old).isin(prefixes))
        rows = part.groupBy(F.substring(key, 1, width).alias("p")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((Segment(r["p"], int(r["s"]), int(r["n"])) for r in rows), key=lambda x: x.prefix)

    parts = look(None, digits)
    while True:
        if not parts:
            return [], 0
        sums = [0]
        for x in parts:
            sums.append(sums[-1] + x.size)
        low = max(-(-sums[-1] // shards), max([x.size for x in parts if x.groups == 1], default=0), 1)
        high = _least(parts, sums, shards, False, low)
        least = _least(parts, sums, shards, True, low)
        early, late = _greedy(parts, sums, least, shards, False), _greedy(parts, sums, high, shards, True)
        # Greedy cuts move right with the capacity: the k-th lies between the coarse cut at the lower bound and the fluid cut at the upper one.
        coarse = early if early is not None else _coarse_cuts(parts, sums, least, shards)
        late = late + [sums[-1]] * (len(coarse) - len(late))
        touched = {i for lo, hi in zip(coarse, late) for i in range(max(0, bisect.bisect_left(sums, lo) - 1), min(len(parts), bisect.bisect_right(sums, hi) + 1))}
        fine = sorted(i for i in touched if parts[i].groups > 1)
        if not fine:
            hot = next((i for i, x in enumerate(parts) if x.groups == 1 and x.size == high), None)
            if hot is not None and high > -(-sums[-1] // shards):
                return _around(groups, parts, hot, shards, key=key, size=size, segments=segments), high
            cuts = _greedy(parts, sums, high, shards, False)
            return [parts[bisect.bisect_left(sums, c)].prefix for c in cuts[:-1]], high
        width = min(len(parts[i].prefix) for i in fine)
        now = [i for i in fine if len(parts[i].prefix) == width][: max(1, segments // 16)]
        finer = look([parts[i].prefix for i in now], width + 1)
        keep = [x for i, x in enumerate(parts) if i not in set(now)]
        parts = sorted(keep + finer, key=lambda x: x.prefix)


def _around(groups: DataFrame, parts: list[Segment], hot: int, shards: int, *, key: str, size: str, segments: int) -> list[str]:
    """First keys of shards where one group, parts[hot], sets the capacity: the stretches before and after it are cut on their own."""

    def least(stretch: list[Segment], n: int) -> int | None:
        if not stretch or not n:
            return None if stretch else 0
        sums = [0]
        for x in stretch:
            sums.append(sums[-1] + x.size)
        return _least(stretch, sums, n, False, 1)

    before, after, prefix = parts[:hot], parts[hot + 1 :], parts[hot].prefix
    costs = {n: (least(before, n), least(after, shards - 1 - n)) for n in range(shards)}
    costs = {n: max(c) for n, c in costs.items() if None not in c}
    n = min(costs, key=lambda n: (costs[n], n))
    place, starts = F.substring(key, 1, len(prefix)), []
    if before:
        starts += minimax_cuts(groups.where(place < prefix), n, key=key, size=size, segments=segments)[0] + [prefix]
    if after:
        starts += [after[0].prefix] + minimax_cuts(groups.where(place > prefix), shards - 1 - n, key=key, size=size, segments=segments)[0]
    return starts


def _coarse_cuts(parts: list[Segment], sums: list[int], capacity: int, shards: int) -> list[int]:
    """Lower bounds of the cuts at a capacity: a segment that does not fit whole is left for the next shard."""
    cuts, at = [], 0
    for _ in range(shards):
        i = bisect.bisect_right(sums, at + capacity) - 1
        at = max(at, sums[i])
        cuts.append(at)
    return cuts


def minimax_shards(
    docs: DataFrame, shards: int, *, text_col: str = "text", id_col: str = "doc_id", group_key: Column | None = None, sub_rows: int = SUB_ROWS, segments: int = SEGMENTS,
) -> DataFrame:
    """id, size, text_crc32, shard int, slot long for each row of docs; at most one shard a group, sizes near equal."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
        (group_key if group_key is not None else F.coalesce(F.md5(text.cast("binary")), F.lit("0" * 32))).alias("_key"),
    )
    rows = checkpointed(rows.groupBy("_id", "_size", "_crc", "_key").agg(F.count(F.lit(1)).alias("_n")))
    subs = max(SUBS, -(-rows.count() // sub_rows))
    rows = rows.withColumn("_sub", F.pmod(F.xxhash64("_id"), F.lit(subs)).cast("int"))
    runs = rows.groupBy("_key", "_sub").agg(F.sum(F.col("_size") * F.col("_n")).alias("_rsize"), F.sum("_n").alias("_rcount"))
    groups = checkpointed(runs.groupBy("_key").agg(F.sum("_rsize").alias("_gsize"), F.sum("_rcount").alias("_gcount")))
    starts, _ = minimax_cuts(groups, shards, segments=segments)
    # A cut is a prefix of keys: a key belongs to the last shard whose first prefix is not beyond it.
    shard = F.lit(0)
    for p in starts:
        shard = shard + (F.substring("_key", 1, len(p)) >= p).cast("int")
    # Ranks: runs before a run in its bucket of keys, buckets before a bucket (65,536 at most) in its shard.
    runs = runs.withColumn("_shard", shard).withColumn("_bucket", F.substring("_key", 1, 4))
    buckets = runs.groupBy("_shard", "_bucket").agg(F.sum("_rcount").alias("_bcount"))
    upto = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("_shard").alias("_bshard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_bcount").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_shard", "_bucket").orderBy("_key", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        runs.withColumn("_inside", F.coalesce(F.sum("_rcount").over(within), F.lit(0)))
        .join(buckets, (F.col("_shard") == F.col("_bshard")) & (F.col("_bucket") == F.col("_b")))
        .select(F.col("_key").alias("_rkey"), F.col("_sub").alias("_rsub"), "_shard", (F.col("_before") + F.col("_inside")).alias("_first"))
    )
    upto = Window.partitionBy("_key", "_sub").orderBy(F.col("_id").asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_nth", F.sum("_n").over(upto) - F.col("_n")).join(placed, (F.col("_key") == F.col("_rkey")) & (F.col("_sub") == F.col("_rsub")))
    chunks = found.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK)))).repartition("_key", "_id", "_chunk")
    first = F.col("_chunk") * CHUNK
    each = chunks.withColumn("_copy", F.explode(F.sequence(first, F.least(F.col("_n"), first + CHUNK) - 1)))
    return each.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_first") + F.col("_nth") + F.col("_copy")).cast("long").alias("slot")
    )
