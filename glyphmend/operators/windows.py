"""Windows of letters around foldable letters, over whole batches of texts in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphmend.functions.letters import ACCENTED, PLAIN, az_lower, strip_diacritics

RADIUS = 4
WIDTH = 2 * RADIUS + 1
#: Characters with a code of their own; windows with any other are few and go as they are.
CODES, BITS = 127, 7
#: Letters whose windows a task counts at once.
AT_ONCE = 4_000_000
POINTS = 0x110000
#: The order of a window's characters in its path, inside out, so that a narrower window's path begins a wider one's.
INSIDE_OUT = [2, 3, 4, 5, 6, 1, 7, 0, 8]
_SIGMA = "Σ"
_TABLE: dict = {}


def key_table(spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spark's own reading of every character: (changed, to what, those that become several) in the lower case without marks."""
    if not _TABLE:
        every = [chr(c) for c in range(POINTS) if not 0xD800 <= c < 0xE000 and c != 10]
        got = spark.createDataFrame([("\n".join(every),)], "s string").select(strip_diacritics(az_lower(F.col("s"))).alias("s")).first()["s"].split("\n")
        pairs = [(ord(a), ord(b)) for a, b in zip(every, got, strict=True) if len(b) == 1 and a != b]
        odd = [ord(a) for a, b in zip(every, got) if len(b) != 1]
        _TABLE["all"] = (np.array([a for a, _ in pairs], dtype=np.uint32), np.array([b for _, b in pairs], dtype=np.uint32), np.array(odd, dtype=np.uint32))
    return _TABLE["all"]


@cache
def _strips() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables over code points: without its mark, the place of its plain letter in PLAIN (or -1), with a mark."""
    plain = np.arange(POINTS, dtype=np.uint32)
    plain[[ord(c) for c in ACCENTED]] = [ord(c) for c in PLAIN]
    place = np.full(POINTS, -1, dtype=np.int8)
    place[[ord(c) for c in PLAIN]] = np.arange(len(PLAIN))
    place[[ord(c) for c in ACCENTED]] = np.arange(len(PLAIN))
    marked = np.arange(POINTS, dtype=np.uint32)
    marked[[ord(c) for c in PLAIN]] = [ord(c) for c in ACCENTED]
    return plain, place, marked


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Letters:
    """The foldable letters of some texts (null for none): row, at, place (in PLAIN), label, and their windows."""

    def __init__(self, texts: list[str | None], table: tuple[np.ndarray, np.ndarray, np.ndarray]):
        changed, to, odd = table
        lower = np.arange(POINTS, dtype=np.uint32)
        lower[changed] = to
        given = [t or "" for t in texts]
        self.lengths = np.array([len(t) for t in given], dtype=np.int64)
        self.points = _points("".join(given))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if given else np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(len(given)), self.lengths)
        keys = lower[self.points]
        for i in {int(row[j]) for j in np.nonzero(self.points == ord(_SIGMA))[0]}:
            # The last letter of a word has a form of its own.
            whole = given[i].translate({ord("I"): "ı", ord("İ"): "i"}).lower().translate(str.maketrans(ACCENTED, PLAIN))
            if len(whole) == self.lengths[i]:
                keys[self.starts[i] : self.starts[i] + self.lengths[i]] = _points(whole)
        place = _strips()[1][self.points]
        fold = place >= 0
        if len(odd):
            # Texts whose lower case has another length are not aligned.
            strange = np.zeros(POINTS, dtype=bool)
            strange[odd] = True
            bad = np.zeros(len(given) + 1, dtype=bool)
            bad[row[strange[self.points]]] = True
            fold &= ~bad[row]
        self.index = np.nonzero(fold)[0]
        self.row = row[self.index]
        self.at = (self.index - self.starts[self.row]).astype(np.int32)
        self.place = place[self.index]
        self.label = (_strips()[0][self.points[self.index]] != self.points[self.index]).astype(np.uint8)
        # Blanks between texts, so that a window never reaches the next.
        self.padded = np.full(len(keys) + RADIUS * (len(given) + 1), 32, dtype=np.uint32)
        self.padded[np.arange(len(keys)) + RADIUS * (row + 1)] = keys
        self.centre = self.index + RADIUS * (self.row + 1)

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each window, whether it is one (all its characters have codes), and the characters by code."""
        counts = np.bincount(self.padded) if len(self.padded) else np.zeros(1, dtype=np.int64)
        present = np.nonzero(counts)[0]
        common = np.sort(present[np.argsort(-counts[present], kind="stable")[:CODES]])
        code = np.full(len(counts), CODES, dtype=np.uint8)
        code[common] = np.arange(len(common))
        coded = code[self.padded]
        rare = np.concatenate([[0], np.cumsum(coded == CODES)])
        fine = rare[self.centre + RADIUS + 1] == rare[self.centre - RADIUS]
        out = np.zeros(len(self.centre), dtype=np.uint64)
        for k in range(-RADIUS, RADIUS + 1):
            out = (out << np.uint64(BITS)) | coded[self.centre + k].astype(np.uint64)
        return out, fine, common.astype(np.uint32)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """(n, WIDTH) characters of the chosen letters' windows."""
        return self.padded[self.centre[which][:, None] + np.arange(-RADIUS, RADIUS + 1)]


def decoded(codes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """(n, WIDTH) characters of window numbers."""
    shifts = np.array([BITS * (WIDTH - 1 - k) for k in range(WIDTH)], dtype=np.uint64)
    return common[((codes[:, None] >> shifts) & np.uint64(CODES)).astype(np.int64)] if len(codes) else np.zeros((0, WIDTH), dtype=np.uint32)


def strings(points: np.ndarray) -> pa.Array:
    """(n, width) code points as n strings."""
    sizes = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.zeros(len(points) + 1, dtype=np.int32)
    np.cumsum(sizes.sum(axis=1), out=offsets[1:])
    data = np.ascontiguousarray(points, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(data))


def _sums(keys: np.ndarray, seen: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sums of both."""
    if not len(keys):
        return keys, seen, marked
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[first], np.add.reduceat(seen[order], first), np.add.reduceat(marked[order], first)


def counted(letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows (n, WIDTH), how often each is seen, and how often marked."""
    codes, fine, common = letters.codes()
    both = np.sort((codes[fine] << np.uint64(1)) | letters.label[fine].astype(np.uint64))
    keys = both >> np.uint64(1)
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, dtype=np.int64)
    seen = np.diff(np.concatenate([first, [len(keys)]]))
    marked = np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)
    points, other = decoded(keys[first], common), np.nonzero(~fine)[0]
    if len(other):
        k, s, m = _sums(np.array([x.tobytes() for x in letters.windows(other)], dtype=object), np.ones(len(other), dtype=np.int64), letters.label[other].astype(np.int64))
        more = np.frombuffer(b"".join(k.tolist()), dtype="<u4").reshape(-1, WIDTH)
        points, seen, marked = np.concatenate([points, more]), np.concatenate([seen, s]), np.concatenate([marked, m])
    return points, seen.astype(np.int64), marked.astype(np.int64)


def counting(table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: texts to (path, seen, marked) of the widest windows, and of the narrowest (three characters)."""

    def flush(texts: list[str]) -> pa.RecordBatch:
        points, seen, marked = counted(Letters(texts, table))
        middle = points[:, RADIUS - 1 : RADIUS + 2].astype(np.uint64)
        # Three code points of 21 bits are one number.
        keys, s, m = _sums((middle[:, 0] << np.uint64(42)) | (middle[:, 1] << np.uint64(21)) | middle[:, 2], seen, marked)
        narrow = np.column_stack([(keys >> np.uint64(x)) & np.uint64((1 << 21) - 1) for x in (42, 21, 0)]).astype(np.uint32)
        path = pa.concat_arrays([strings(points[:, INSIDE_OUT]), strings(narrow)])
        return pa.RecordBatch.from_arrays([path, pa.array(np.concatenate([seen, s])), pa.array(np.concatenate([marked, m]))], names=["path", "seen", "marked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.append(t)
                    size += len(t)
                    # A third or so of all letters is foldable.
                    if size >= 3 * AT_ONCE:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def asking(table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow: a block's texts to its distinct windows (block, path)."""

    def run(block: pa.Table) -> pa.Table:
        points, _, _ = counted(Letters(block.column("text").to_pylist(), table))
        return pa.table({"block": pa.array(np.full(len(points), block.column("block")[0].as_py(), dtype=np.int64)), "path": strings(points[:, INSIDE_OUT])})

    return run


def resolving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (path, kind, block, probability) rows in order of path and kind, to (block, path, probability) of those of kind 9.

    Kinds 2 to 4 are the model's windows of that radius.  They stand before all windows that they begin, so the last
    of each radius is the one to compare with; the widest that fits decides, null where none does.
    """
    held = None
    for b in batches:
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        rows = rows.combine_chunks()
        path, kind = rows.column("path").combine_chunks(), rows.column("kind").to_numpy()
        known = rows.column("probability").to_numpy()
        at, n = np.arange(len(kind)), 0 if held is None else len(held)
        found, keep = np.full(len(kind), np.nan), []
        for radius in (2, 3, 4):
            last = np.maximum.accumulate(np.where(kind == radius, at, -1)) if len(at) else at
            if len(last) and last[-1] >= 0:
                keep.append(last[-1])
            fits = np.zeros(len(kind), dtype=bool)
            some = np.nonzero((kind == 9) & (last >= 0))[0]
            if len(some):
                mine = pc.utf8_slice_codeunits(path.take(pa.array(some)), 0, 2 * radius + 1)
                fits[some] = pc.equal(mine, path.take(pa.array(last[some]))).to_numpy(zero_copy_only=False)
            found[fits] = known[last[fits]]
        asked = np.nonzero((kind == 9) & (at >= n) & ~(found == 0))[0]
        p = found[asked]
        yield pa.RecordBatch.from_arrays([rows.column("block").combine_chunks().take(pa.array(asked)), path.take(pa.array(asked)), pa.array(p, mask=np.isnan(p))], names=["block", "path", "probability"])
        held = rows.take(pa.array(sorted(keep), pa.int64()))


def _found(letters: Letters, hits: pa.Table) -> np.ndarray:
    """The probability of each letter from (path, probability) rows; 0 without one."""
    out = np.zeros(len(letters.index))
    if not len(hits) or not len(out):
        return out
    points = np.empty((len(hits), WIDTH), dtype=np.uint32)
    points[:, INSIDE_OUT] = _points("".join(hits.column("path").to_pylist())).reshape(-1, WIDTH)
    p = hits.column("probability").to_numpy()
    codes, fine, common = letters.codes()
    code = np.full(POINTS, CODES, dtype=np.uint64)
    code[common] = np.arange(len(common))
    of = code[points]
    plain = (of != CODES).all(axis=1)
    known = np.zeros(len(points), dtype=np.uint64)
    for k in range(WIDTH):
        known = (known << np.uint64(BITS)) | of[:, k]
    order = np.argsort(known[plain])
    known, value = known[plain][order], p[plain][order]
    if len(known):
        asked = codes[fine]
        near = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        out[fine] = np.where(known[near] == asked, value[near], 0.0)
    other = np.nonzero(~fine)[0]
    if len(other) and not plain.all():
        rare = {points[i].tobytes(): p[i] for i in np.nonzero(~plain)[0]}
        out[other] = [rare.get(w.tobytes(), 0.0) for w in letters.windows(other)]
    return out


def placing(table: tuple[np.ndarray, np.ndarray, np.ndarray], kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogrouped applyInArrow: a block's texts and windows to its letters (id, at, place, label, probability)."""

    def run(block: pa.Table, hits: pa.Table) -> pa.Table:
        x = Letters(block.column("text").to_pylist(), table)
        ids = block.column("id").combine_chunks().take(pa.array(x.row)) if len(block) else pa.array([], kind)
        return pa.table({"id": ids, "at": pa.array(x.at), "place": pa.array(x.place.astype(np.int32)), "label": pa.array(x.label.astype(np.int32)), "probability": pa.array(_found(x, hits))})

    return run


def marking(table: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogrouped applyInArrow: a block's texts with a mark wherever its probability is over ``least``."""

    def run(block: pa.Table, hits: pa.Table) -> pa.Table:
        texts = block.column("text").to_pylist()
        x = Letters(texts, table)
        points = x.points.copy()
        at = x.index[_found(x, hits) > least]
        points[at] = _strips()[2][points[at]]
        whole = points.tobytes().decode("utf-32-le", "surrogatepass")
        restored = [None if t is None else whole[s : s + n] for t, s, n in zip(texts, x.starts, x.lengths)]
        return pa.table({"id": block.column("id"), "restored": pa.array(restored, pa.string())})

    return run
