"""Substring deduplication by content-defined chunks.

A gear rolling hash, h = 2 h + G[byte] modulo 2**16, runs over the UTF-8 bytes.  A chunk ends where a
word ends and the low byte of the hash, which sees the last eight bytes only, is below ``CUT``; so the
boundaries depend on nearby text alone and come back right after an insertion.  Text without white
space is cut inside, by the same hash.

The unit of comparison is a variable run of whole chunks, from each chunk's start to the first
boundary at which it has ``MIN_WORDS`` words (or ``MIN_BYTES`` bytes).  Runs are compared by a 64-bit
digest; the first in order of (id, digest of the text, position) stays and every later one is cut out, in
the same document too.
A passage kept nowhere cannot arise: what is cut has an earlier equal.

Scale: a map task keeps one run of each digest a batch, packs them by bucket into binary columns, and
only those 18 bytes a run are shuffled; its later runs leave at once as joined spans.  So a passage in a
third of all documents costs its bucket one run a batch.  Buckets are counted by the bytes of all texts, so
that one holds the runs of about ``BUCKET_BYTES`` of text.  Texts are shuffled once, to meet their cut spans.

Defined cases: null and empty texts stay; repeated rows (same id, same text) are one document and are
treated alike; texts shorter than the least run stay whole; very long texts are read whole, and a text without a
chunk end (one letter, no white space) is one run of any length; null ids come last; an empty table gives
an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmend.llm.common import unpacked, whole_row

MIN_WORDS = 16
MIN_BYTES = 240
#: Of 256: the share of word ends that end a chunk.
CUT = 64
#: Longest stretch without white space; beyond it characters are places for a cut.
STRETCH = 64
CUT_INSIDE = 10

#: 256 values from a fixed linear congruential sequence.
GEAR = np.empty(256, dtype=np.uint16)
_x = 0x9E3779B9
for _i in range(256):
    _x = (_x * 1664525 + 1013904223) % (1 << 32)
    GEAR[_i] = _x >> 16


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash modulo 2**16 after each byte, by doubling the window: 1, 2, 4, 8, 16 bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Starts of all chunks, and the length of data at the end."""
    n = len(data)
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    low = (gear_hash(data) & np.uint16(255))[:-1]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = space[:-1] & ~space[1:]
    cut = starts & (low < CUT)
    last = np.maximum.accumulate(np.where(space, np.arange(n), -1))[:-1]
    inside = (np.arange(n - 1) - last > STRETCH) & ((data[1:] & 0xC0) != 0x80) & (low < CUT_INSIDE)
    return np.concatenate(([0], np.flatnonzero(cut | inside) + 1, [n]))


def runs(text: bytes, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, end) of the run that begins at each chunk and fits into the text."""
    data = np.frombuffer(text, dtype=np.uint8)
    cuts = boundaries(data)
    if len(cuts) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.concatenate(([0], np.cumsum(begins)))[cuts]
    by_words = np.searchsorted(words, words + min_words, side="left")
    by_bytes = np.searchsorted(cuts, cuts + min_bytes, side="left")
    to = np.minimum(by_words, by_bytes)
    ok = np.flatnonzero(to < len(cuts))
    starts, ends = cuts[ok], cuts[to[ok]]
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64), starts, ends


_DOC = [("null", "u1"), ("id", "<i8"), ("text", "<i8")]
_RUN = np.dtype([("digest", "<u8"), *_DOC, ("start", "<u4"), ("len", "<u4")])
_PACKED = np.dtype([("digest", "<u8"), ("doc", "<u2"), ("start", "<u4"), ("len", "<u4")])
_SPAN = np.dtype([*_DOC, ("start", "<u4"), ("len", "<u4")])
#: Text whose runs a bucket should hold: they are sorted in memory, at about 60 bytes a run of some 24 bytes of text.
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 48
#: Documents in a pack at most; their numbers in it fit 16 bits.
PER_PACK = 1 << 12


def _after_first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each digest and its like, all others) of runs, in order of (null, id, text, start); a repeated row's runs are like it."""
    by = np.argsort(x["digest"], kind="stable")
    same = x["digest"][by][1:] == x["digest"][by][:-1]
    shared = np.zeros(len(x), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    alone, x = x[by[~shared]], x[by[shared]]
    # Most digests are alone: only the others are sorted by all fields.
    x = x[np.lexsort((x["start"], x["text"], x["id"], x["null"], x["digest"]))]
    new = np.ones(len(x), dtype=bool)
    new[1:] = x["digest"][1:] != x["digest"][:-1]
    first = x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
    again = np.zeros(len(x), dtype=bool)
    for f in ("null", "id", "text", "start"):
        again |= x[f] != first[f]
    return np.concatenate([alone, x[~again]]), x[again]


def _spans(x: np.ndarray) -> np.ndarray:
    """Runs of the same document that touch or overlap, as one span."""
    x = x[np.lexsort((x["start"], x["text"], x["id"], x["null"]))]
    if not len(x):
        return np.empty(0, _SPAN)
    end = x["start"].astype(np.int64) + x["len"]
    doc = np.zeros(len(x), dtype=np.int64)
    for f in ("null", "id", "text"):
        doc[1:] |= x[f][1:] != x[f][:-1]
    doc = np.cumsum(doc)
    # Ends so far, kept apart by document: a shift of more than any length.
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * wide) - doc * wide
    begins = np.ones(len(x), dtype=bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (x["start"][1:] > reach[:-1])
    at = np.flatnonzero(begins)
    out = np.empty(len(at), dtype=_SPAN)
    for f in ("null", "id", "text", "start"):
        out[f] = x[f][at]
    out["len"] = np.append(reach[at[1:] - 1], reach[-1]) - out["start"]
    return out


def _runs_of(b: pa.RecordBatch) -> np.ndarray:
    """The runs of all documents of a batch (_id, _text, _hash)."""
    parts = []
    null, ids, texts = b["_id"].is_null().to_numpy(zero_copy_only=False), b["_id"].fill_null(0).to_numpy(), b["_hash"].to_numpy()
    for i, t in enumerate(b["_text"].to_pylist()):
        h, s, e = runs(t.encode("utf-8", "surrogatepass")) if t else (np.empty(0, np.uint64), None, None)
        if len(h):
            x = np.empty(len(h), dtype=_RUN)
            x["digest"], x["null"], x["id"], x["text"], x["start"], x["len"] = h, null[i], ids[i], texts[i], s, e - s
            parts.append(x)
    return np.concatenate(parts) if parts else np.empty(0, _RUN)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(keys[order])) + 1, [len(keys)])).tolist()
    for a, z in zip(edges[:-1], edges[1:]):
        if z > a:
            yield int(keys[order[a]]), order[a:z]


def _pack(buckets: int):
    """Batches of (_id, _text, _hash) to packs (bucket, docs, runs, spans).

    A pack has one run of each digest, the first of the batch; the batch's later ones are known to be
    later, and go as spans, dealt by document.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), PER_PACK):
                firsts, others = _after_first(_runs_of(batch.slice(k, PER_PACK)))
                rows: list[tuple[int, bytes, bytes, bytes]] = []
                for bucket, at in _groups((firsts["digest"] >> np.uint64(40)) % np.uint64(buckets)):
                    part = firsts[at]
                    of = np.empty(len(part), dtype=_DOC)
                    for f in ("null", "id", "text"):
                        of[f] = part[f]
                    docs, which = np.unique(of, return_inverse=True)
                    packed = np.empty(len(part), dtype=_PACKED)
                    packed["digest"], packed["doc"], packed["start"], packed["len"] = part["digest"], which, part["start"], part["len"]
                    rows.append((bucket, docs.tobytes(), packed.tobytes(), b""))
                spans = _spans(others)
                for bucket, at in _groups(spans["text"].view(np.uint64) % np.uint64(buckets)):
                    rows.append((bucket, b"", b"", spans[at].tobytes()))
                if rows:
                    names, *blobs = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], names=["bucket", "docs", "runs", "spans"])

    return pack


def _later(table: pa.Table) -> pa.Table:
    """Spans of all runs in a bucket of digests but the first of each digest, and the spans known before."""
    parts, out = [np.empty(0, _RUN)], [np.empty(0, _SPAN)]
    for d, r, s in zip(table["docs"].to_pylist(), table["runs"].to_pylist(), table["spans"].to_pylist()):
        out.append(np.frombuffer(s, dtype=_SPAN))
        packed = np.frombuffer(r, dtype=_PACKED)
        of, x = np.frombuffer(d, dtype=_DOC)[packed["doc"]], np.empty(len(packed), dtype=_RUN)
        for f in ("null", "id", "text"):
            x[f] = of[f]
        for f in ("digest", "start", "len"):
            x[f] = packed[f]
        parts.append(x)
    out.append(_spans(_after_first(np.concatenate(parts))[1]))
    x = np.concatenate(out)
    start = x["start"].astype(np.int64)
    return pa.table({"sid": pa.array(x["id"].copy(), mask=x["null"] == 1), "stext": pa.array(x["text"].copy()), "start": pa.array(start), "end": pa.array(start + x["len"])})


def later_runs(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """sid, stext (xxhash64 of the text), start, end: byte spans of every run that an earlier place has."""
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        buckets = max(LEAST_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    packs = rows.mapInArrow(_pack(buckets), "bucket int, docs binary, runs binary, spans binary")
    return packs.groupBy("bucket").applyInArrow(_later, "sid long, stext long, start long, end long")


def _merge(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


#: Cut spans of a text, in bytes.
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, counts, gone = [], [], []
        for t, packed in zip(b["_text"].to_pylist(), b["_spans"].to_pylist()):
            spans = _merge([p["start"] for p in packed], [p["end"] for p in packed]) if t and packed else []
            if not spans:
                texts.append(t), counts.append(0), gone.append([])
                continue
            raw, kept, at = t.encode("utf-8", "surrogatepass"), [], 0
            for a, z in spans:
                kept.append(raw[at:a])
                at = z
            kept.append(raw[at:])
            cut = b"".join(kept).decode("utf-8", "surrogatepass")
            texts.append(cut), counts.append(len(t) - len(cut)), gone.append([{"start": a, "end": z} for a, z in spans])
        yield pa.RecordBatch.from_arrays([b["_row"], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, _SPANS)], names=["_row", "_kept", "_removed", "_gone"])


def dedup_substrings(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """The columns of docs with repeated passages cut out of the text, and _removed (code points), _gone (byte spans)."""
    spans = later_runs(docs, text_col=text_col, id_col=id_col, buckets=buckets)
    by_doc = spans.groupBy("sid", "stext").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    others = [c for c in docs.columns if c != text_col]
    keyed = docs.select(whole_row(docs, others), F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"))
    joined = keyed.join(by_doc, F.col("_id").eqNullSafe(F.col("sid")) & (F.col("_hash") == F.col("stext")), "left").select("_row", "_text", "_spans")
    schema = T.StructType([joined.schema["_row"], T.StructField("_kept", T.StringType()), T.StructField("_removed", T.LongType()), T.StructField("_gone", SPANS)])
    return joined.mapInArrow(_cut, schema).select(*unpacked(docs.columns, **{text_col: F.col("_kept")}), "_removed", "_gone")
