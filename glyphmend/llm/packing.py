"""Packing token ids into sequences: first-fit decreasing in randomised groups of documents.

Documents are tokenised whole, in their map task, and dealt by hash into groups of about
``GROUP_DOCS``; only their packed ids are shuffled.  In a group, full sequences are cut from long
documents and the rests are placed, largest first, into the first sequence with room, which a
tournament tree of free capacities finds in log(n) steps.  A sequence that would still be padded by
more than ``SLACK`` tokens is cut into runs of power-of-two length, which need no padding.

Defined cases: null and empty texts are the end id alone; repeated rows are documents of their own
(each occurrence is dealt by its number, so a row repeated in a third of the table spreads out);
very long texts give many full sequences; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 2048
#: Tokens of padding that a sequence may have.
SLACK = 16

_CODERS: dict = {}


def coder(path: str):
    """The tokenizer of a file, once a worker process."""
    from glyphmend.llm.wordbpe import WordBpe

    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


class Bins:
    """Free room of sequences in a tournament tree: each inner node holds the most room below it."""

    def __init__(self, count: int, room: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, count):
            self.leaves *= 2
        self.tree = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first sequence with room for size, whose room shrinks by it."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] >= size else 2 * at + 1
        tree[at] -= size
        found = at - self.leaves
        at //= 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
        return found


def pack(sizes: list[int], length: int = LENGTH, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these sizes."""
    out, bins, sequence = [], defaultdict(list), 0
    rests = []
    for i, n in enumerate(sizes):
        full = n // length
        for k in range(full):
            out.append((i, k * length, length, sequence, 0))
            sequence += 1
        if n % length:
            rests.append((n % length, i, full * length))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = Bins(len(rests), length)
    for size, i, start in rests:
        bins[tree.first_fit(size)].append((i, start, size))
    for b in sorted(bins):
        pieces = bins[b]
        used = sum(p[2] for p in pieces)
        runs = [used] if length - used <= slack else [1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1]
        at, room = 0, runs[0]
        for i, start, size in pieces:
            while size:
                part = min(size, room - at)
                out.append((i, start, part, sequence, at))
                start, size, at = start + part, size - part, at + part
                if at == room:
                    runs.pop(0)
                    sequence, at, room = sequence + 1, 0, runs[0] if runs else 0
        if at:
            sequence += 1
    return out


def _tokenise(path: str, groups: int, end_id: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen, tail = coder(path), defaultdict(int), np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for k in range(0, len(whole), 512):
                b = whole.slice(k, 512)
                group, order = [], []
                for h in b["_hash"].to_pylist():
                    nth = seen[h]
                    seen[h] += 1
                    x = xxhash.xxh64_intdigest(f"{h}:{nth}")
                    group.append(x % groups), order.append(x >> 1)
                ids = [np.frombuffer(e + tail, dtype="<u4") for e in code.encode_many(b["_text"].to_pylist())]
                ids = [(x.astype("<u2") if x.max() < 65536 else x).tobytes() + (b"\0" if x.max() < 65536 else b"\1") for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group, pa.int32()), pa.array(order, pa.int64()), b["_id"], pa.array(ids, pa.binary())], names=["group", "order", "_id", "ids"]
                )
        # Workers outlive their stage: pieces that stay would take room beside all that run after it.
        code.cache.clear()

    return tokenise


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed[:-1], dtype="<u4" if packed[-1] else "<u2").astype("<u4")


def _pack_group(length: int, slack: int, keep_ids: bool):
    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("_id", "ascending")])
        docs = [_unpacked(x) for x in table["ids"].to_pylist()]
        pieces = pack([len(d) for d in docs], length, slack)
        group = table["group"][0].as_py()
        which, start, size, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces))
        cut = [docs[i][a : a + n].tobytes() for i, a, n, _, _ in pieces]
        held = np.bincount(sequence, weights=size).astype(np.int64)
        padded = np.where(held & (held - 1) == 0, held, length)
        columns = {
            "_id": table["_id"].take(pa.array(which)),
            "start": pa.array(start),
            "length": pa.array(size),
            "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64()),
            "doc_tokens": pa.array(np.array([len(d) for d in docs], dtype=np.int64)[which]),
            "sequence_id": pa.array((group << 32) + sequence),
            "offset": pa.array(offset),
            "sequence_length": pa.array(padded[sequence]),
        }
        if keep_ids:
            columns["ids"] = pa.array(cut, pa.binary())
        return pa.table(columns)

    return pack_group


def pack_documents(
    docs: DataFrame, tokenizer: str, *, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, end_id: int = END_ID,
    group_docs: int = GROUP_DOCS, slack: int = SLACK, keep_ids: bool = False,
) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length (padded), ids if kept.

    tokenizer: path of a word-level BPE file, present on every executor.
    """
    groups = max(1, round(docs.count() / group_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_hash"))
    coded = rows.mapInArrow(_tokenise(tokenizer, groups, end_id), f"group int, order long, _id {kind}, ids binary")
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long" + ", ids binary" * keep_ids
    return coded.groupBy("group").applyInArrow(_pack_group(length, slack, keep_ids), schema).withColumnRenamed("_id", id_col)
