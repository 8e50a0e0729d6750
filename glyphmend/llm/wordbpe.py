"""Whole texts to token ids of a word-level BPE file, faster than a call a text.

The tokenizer splits a normalised text into pieces and merges each on its own, so a text's ids are
those of its pieces in a row, and pieces come back often: they are kept in a bounded cache as packed
ids.  Texts of Latin letters, digits and ASCII signs (their normalisation is lower-casing) are split
here by the file's own pattern, restricted to these characters, and all unknown pieces of many texts
are merged at once in numpy, in order of the file's merge ranks.  In other texts the words of other
characters go to the tokenizer itself, and texts with a special token's string go there whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

#: Pieces kept; the cache is emptied when it is full.
CACHE_PIECES = 1_000_000
#: Longest piece, in bytes, that is merged in numpy.
WIDTH = 40
LETTER = "a-zß-öø-ÿ"
#: Texts whose normalisation is lower-casing, character by character.
SIMPLE = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿ]*")
WORD = re.compile(r"[^\t-\r ]+")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\t-\\r {LETTER}0-9]+")
NONE = np.int32(1 << 30)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.cache: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (b >= 0), self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of non-empty lower-case pieces, WIDTH bytes each at most."""
        out = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for low, high in ((1, 6), (7, 10), (11, 16), (17, WIDTH)):
            rows = np.flatnonzero((size >= low) & (size <= high))
            if not len(rows):
                continue
            n = size[rows]
            flat = np.frombuffer(b"".join([pieces[i].ljust(high, b"\0") for i in rows.tolist()]), dtype=np.uint8).reshape(len(rows), high)
            ids = self.inner[flat]
            ids[np.arange(high) >= n[:, None]] = -1
            at = np.arange(len(rows))
            ids[at, n - 1] = self.final[flat[at, n - 1]]
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], axis=1)
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            done = np.empty_like(ids)
            live = at
            cols = np.arange(high + 1)
            while len(live):
                j = rank.argmin(axis=1)
                k = np.arange(len(live))
                best = rank[k, j]
                go = best < NONE
                done[live[~go]] = ids[~go]
                live, ids, rank, j, best = live[go], ids[go], rank[go], j[go], best[go]
                if not len(live):
                    break
                k = np.arange(len(live))
                shift = np.minimum(cols + (cols > j[:, None]), high)
                ids = np.take_along_axis(ids, shift, axis=1)
                ids[:, -1] = -1
                ids[k, j] = self.made[best]
                rank = np.take_along_axis(rank, np.minimum(shift[:, :-1], high - 1), axis=1)
                rank[:, -1] = NONE
                rank[k, j] = self._rank(ids[k, j], ids[k, j + 1])
                prev = np.maximum(j - 1, 0)
                rank[k, prev] = np.where(j > 0, self._rank(ids[k, prev], ids[k, prev + 1]), rank[k, prev])
            ends = np.cumsum((done >= 0).sum(axis=1) * 4).tolist()
            packed, start = done[done >= 0].astype("<u4").tobytes(), 0
            for r, stop in zip(rows.tolist(), ends):
                out[r] = packed[start:stop]
                start = stop
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Put pieces (or whole words of other characters) into the cache."""
        short = [p for p in pieces if len(p) <= WIDTH // 2 and p[0] != "\n"]
        self.cache.update(zip(short, self.merge([p.encode() for p in short])))
        rest = list(pieces.difference(short))
        for p, e in zip(rest, self.tokenizer.encode_batch([_clean(p) for p in rest], add_special_tokens=False)):
            self.cache[p] = _packed(e)

    def _split(self, text: str) -> list[str]:
        """Pieces in order; words that need the tokenizer's own normalisation come whole, after a line feed."""
        if SIMPLE.fullmatch(text):
            return PIECE.findall(text.lower())
        out = []
        for w in WORD.findall(text):
            if SIMPLE.fullmatch(w):
                out += PIECE.findall(w.lower())
            else:
                out.append("\n" + w)
        return out

    def encode_many(self, texts: list[str | None], chunk: int = 100) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit numbers; null and empty texts have none."""
        out: list[bytes] = []
        for k in range(0, len(texts), chunk):
            whole = {i: t for i, t in enumerate(texts[k : k + chunk]) if t and any(s in t for s in self.special)}
            split = [self._split(t) if t and i not in whole else [] for i, t in enumerate(texts[k : k + chunk])]
            new = set().union(*split).difference(self.cache)
            if new:
                if len(self.cache) + len(new) > CACHE_PIECES:
                    self.cache.clear()
                    new = set().union(*split)
                self._learn(new)
            cache = self.cache
            part = [b"".join([cache[p] for p in pieces]) for pieces in split]
            for i, t in whole.items():
                part[i] = _packed(self.tokenizer.encode(_clean(t), add_special_tokens=False))
            out += part
        return out


def _packed(encoding) -> bytes:
    return np.array(encoding.ids, dtype="<u4").tobytes()


def _clean(text: str) -> str:
    """Lone surrogates, which no tokenizer takes, become U+FFFD."""
    return text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text
