"""Poisson draws of the bootstrap, many at once: MD5 of short texts over numpy arrays."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Digests computed at once: arrays that stay in a core's cache.
AT_ONCE = 1 << 15
#: Bytes that one block of MD5 holds beside its length.
ONE_BLOCK = 55
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_words(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits (big endian) of the MD5 digest of each padded block; blocks: (16, n) little-endian words."""
    n = blocks.shape[1]
    # Words that all blocks share are added as one number.
    same = [int(w[0]) if (w == w[0]).all() else None for w in blocks]
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    f, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(64):
        kind, k = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if same[k] is None:
            np.add(f, blocks[k], out=f)
        np.add(f, np.uint32((_SINES[i] + (same[k] or 0)) & 0xFFFFFFFF), out=f)
        s = _TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        # The old a is not needed again: its array is the next f.
        a, d, c, b, f = d, c, b, f, a
    return (a + np.uint32(_START[0])).byteswap()


def _blocks(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """Padded blocks of every tail after every head, (16, tails * heads); heads are of one length, and so are tails."""
    h, t = len(heads[0]), len(tails[0])
    out = np.zeros((len(tails), len(heads), 64), dtype=np.uint8)
    out[:, :, :h] = np.frombuffer(b"".join(heads), dtype=np.uint8).reshape(1, len(heads), h)
    if t:
        out[:, :, h : h + t] = np.frombuffer(b"".join(tails), dtype=np.uint8).reshape(len(tails), 1, t)
    out[:, :, h + t] = 0x80
    out[:, :, 56:64] = np.frombuffer(((h + t) * 8).to_bytes(8, "little"), dtype=np.uint8)
    return np.ascontiguousarray(out.reshape(-1, 64).view("<u4").T)


def times_of(groups: list[str], resamples: int, seed: int, shares: tuple[float, ...]) -> np.ndarray:
    """(groups, resamples): how often each group is drawn in each resample; groups are best given a few at a time."""
    bounds = [np.uint32(math.ceil(s * (1 << 32))) for s in shares]
    out = np.zeros((len(groups), resamples), dtype=np.uint8)
    heads = defaultdict(list)
    for r in range(resamples):
        head = f"{seed}:{r}:".encode()
        heads[len(head)].append((r, head))
    tails = defaultdict(list)
    for i, g in enumerate(groups):
        tails[len(raw := g.encode())].append((i, raw))
    for h, of_head in heads.items():
        rs = np.array([r for r, _ in of_head])
        for t, of_tail in tails.items():
            if h + t <= ONE_BLOCK:
                first = first_words(_blocks([x for _, x in of_head], [x for _, x in of_tail]))
            else:
                first = np.array([int.from_bytes(hashlib.md5(a + b, usedforsecurity=False).digest()[:4], "big") for _, b in of_tail for _, a in of_head], dtype=np.uint32)
            times = np.zeros(len(first), dtype=np.uint8)
            for x in bounds:
                times += first >= x
            out[np.ix_([i for i, _ in of_tail], rs)] = times.reshape(len(of_tail), len(of_head))
    return out


def resampled_sums(resamples: int, seed: int, shares: tuple[float, ...], counters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (group, counters...) rows to one row a resample, (resample, drawn, weighted sums...) of the task's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, step, any_rows = np.zeros((resamples, counters + 1), dtype=np.int64), max(1, AT_ONCE // max(1, resamples)), False
        for b in batches:
            groups = b.column(0).to_pylist()
            values = np.column_stack([np.ones(len(groups), dtype=np.int64), *[b.column(i + 1).fill_null(0).to_numpy(zero_copy_only=False) for i in range(counters)]])
            for at in range(0, len(groups), step):
                any_rows = True
                # Whole numbers under 2^53 are exact in products and sums of doubles.
                times = times_of(groups[at : at + step], resamples, seed, shares).astype(np.float64)
                sums += np.rint(times.T @ values[at : at + step].astype(np.float64)).astype(np.int64)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32))] + [pa.array(c) for c in np.ascontiguousarray(sums.T)], names=["resample", *[f"s{i}" for i in range(counters + 1)]])

    return run
