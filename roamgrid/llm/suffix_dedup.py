"""Dedup of byte strings by hash-compared suffixes.

Prefix polynomial hashes give the hash of any stretch of a text in constant time, so that a binary
search over lengths finds the longest common extension of two suffixes, and their order follows from
the byte after it. A mergesort with these comparisons sorts the suffixes that begin at anchors, and
another one what lies before the anchors, read backwards. Extensions of neighbours are compared byte
by byte afterwards; where a hash had deceived, the bytes themselves are sorted. Windows around two
anchors are equal if the extensions to both sides are long enough.

Of all suffixes only those that can matter are sorted: each 50-byte window keeps its anchor (the 20
bytes in it with the smallest hash), and suffixes meet by anchors, where their surroundings differ.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Prefix, byte_values, gram_hashes
from ._common import documents
from ._repeats import Contexts, Finder, covered, repeats, window_matches

WINDOW = 50
#: Bytes of an anchor: longer ones are seldom shared by chance, shorter ones are fewer.
SPAN = 20


class Side:
    """What lies after anchors (step 1) or before them, read backwards (step -1): hashes and bytes of any prefix of it.

    at: where each anchor begins in the data; room: how many bytes each has on this side."""

    def __init__(self, data: np.ndarray, prefix: Prefix, at: np.ndarray, room: np.ndarray, step: int) -> None:
        self.data, self.prefix, self.at, self.room, self.step = data, prefix, at, room, step

    def hash(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = self.at[i]
        return self.prefix.span(at, at + n) if self.step > 0 else self.prefix.span(at - n, at)

    def byte(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.data[np.minimum(self.at[i] + k if self.step > 0 else self.at[i] - 1 - k, len(self.data) - 1)]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of each two, by binary search over hashes."""
        most = np.minimum(self.room[i], self.room[j])
        low = np.zeros(len(i), np.int64)
        bit = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while bit:
            n = low + bit
            inside = n <= most
            n = np.where(inside, n, low)
            low = np.where(inside & (self.hash(i, n) == self.hash(j, n)), n, low)
            bit >>= 1
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether i comes before j (or is equal, where allowed); a prefix comes before what it begins."""
        n = self.common(i, j)
        ends_i, ends_j = n == self.room[i], n == self.room[j]
        return np.where(ends_i & ends_j, or_equal, ends_i | (~ends_j & (self.byte(i, n) < self.byte(j, n))))

    def sort(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort of each group (rows start to start + size, given for each row): in each round all
        elements look up their rank in the neighbouring run at once."""
        order = np.arange(len(start))
        own = order - start
        width = 1
        while width < size.max(initial=0):
            rows = np.flatnonzero(size > width)
            run = own[rows] // width
            first = run % 2 == 0
            low = np.minimum((run ^ 1) * width, size[rows])
            begin, high = low.copy(), np.minimum(low + width, size[rows])
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) // 2
                # Elements of the first run come before equal ones of the second.
                before = self.less(order[start[rows[k]] + middle], order[rows[k]], ~first[k])
                low[k], high[k] = np.where(before, middle + 1, low[k]), np.where(before, high[k], middle)
            place = start[rows] + (run // 2) * 2 * width + own[rows] % width + low - begin
            new = order.copy()
            new[place] = order[rows]
            order = new
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common extension of each with the one before it in its group (0 for the first), and whether all are so byte by byte."""
        n = np.zeros(len(order), np.int64)
        rows = np.flatnonzero(start != np.arange(len(start)))
        n[rows] = self.common(order[rows - 1], order[rows])
        flat = np.repeat(rows, n[rows])
        k = np.arange(len(flat)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        return n, bool((self.byte(order[flat - 1], k) == self.byte(order[flat], k)).all())

    def sorted(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and common extensions of neighbours, right whatever the hashes."""
        order = self.sort(start, size)
        n, true = self.neighbours(order, start)
        if true:
            return order, n
        text = [(self.data[a : a + r] if self.step > 0 else self.data[a - r : a][::-1]).tobytes() for a, r in zip(self.at, self.room, strict=True)]
        order = np.array(sorted(range(len(text)), key=lambda i: (start[i], text[i])), np.int64)
        for i in np.flatnonzero(start != np.arange(len(start))):
            a, b = text[order[i - 1]], text[order[i]]
            n[i] = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return order, n


def compare_suffixes(finder: Finder, contexts: Contexts):
    """Windows around anchors of one key are equal if what follows and what precedes their anchors agrees for long enough."""
    by_key = np.argsort(contexts.key, kind="stable")
    for name in ("doc", "pos", "key", "left", "size", "begin"):
        setattr(contexts, name, getattr(contexts, name)[by_key])
    new = np.r_[True, contexts.key[1:] != contexts.key[:-1]] if len(by_key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
    size = np.diff(np.r_[np.flatnonzero(new), len(new)])[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    prefix = Prefix(byte_values(contexts.data) ^ finder.seed)
    at = contexts.begin + contexts.left
    sides = [Side(contexts.data, prefix, at, contexts.size - contexts.left, 1), Side(contexts.data, prefix, at, contexts.left, -1)]
    ordered = [s.sorted(start, size) for s in sides]

    def classes(side: int, least: int) -> np.ndarray:
        """A number for each anchor that is equal where `least` bytes to that side are; keys differ where numbers' groups do."""
        order, n = ordered[side]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum((n < least) | new)
        return out

    def name(back, _, rows):
        return classes(0, finder.window - back)[rows] * (len(new) + 1) + classes(1, back)[rows]

    return 4, *window_matches(contexts, finder.window, finder.span, name)


def finder(seed: int = 0) -> Finder:
    pieces = lambda raw: lambda a, b: raw[a:b].tobytes()
    return Finder(byte_values, lambda values: gram_hashes(values, SPAN) >> np.uint64(1), WINDOW, SPAN, pieces, compare_suffixes, codes=lambda raw: raw, seed=seed)


def _report(raw, a, b):
    if a is None:
        return len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest(), raw.tobytes()
    mask = covered(len(raw), a, b)
    kept = raw[~mask].tobytes()
    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0]) if len(mask) else 0
    return len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes that
    stay, which may split a character). A byte goes if a 50-byte string that covers it also starts
    in a document with a smaller id. Null, empty and short texts lose nothing; see repeats() for ids.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return repeats(d, finder, _report, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir)).drop("kept")
