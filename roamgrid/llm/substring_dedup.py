"""Substring dedup over words by recompression.

Rounds of recompression name runs and pairs of tokens by a hash of what they hold, so that a name
means the same everywhere without a table of names: first runs of two, then twice the pairs of a
`left` and a `right` symbol (which of both a symbol is follows from its name). Inside equal stretches
of words the symbols are equal, but for at most MARGIN words at either end; a symbol holds at most
BLOCK words. (Longer runs stay apart: what they would be named depends on text outside a window.)
Symbols that are shared, with the words around them that every window holds, reveal repeats; joined
to the longest spans that two documents share, these are verified by digests of their words.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import gram_hashes, mix, power, word_hashes
from ._bytes import words as split
from ._common import documents
from ._repeats import TOP, Finder, compare_hashes, covered, repeats

U = np.uint64
WINDOW = 50
#: Words that can be cut differently at either end of equal stretches: 2 by runs, 2 and 4 by pairs.
MARGIN = 8
#: Most words of a symbol: 2 by runs, doubled twice by pairs.
BLOCK = 8
#: Words that all windows around a symbol share: MARGIN before its start, and BLOCK + MARGIN after.
SPAN = 2 * MARGIN + BLOCK


def recompress(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and starts (in words) of the symbols after one round of runs and two of pairs."""
    names, starts = words, np.arange(len(words))
    same = names[1:] == names[:-1]
    edge = np.concatenate([[False], same, [False]])
    # Runs of exactly two.
    two = ~edge[:-2] & same & ~edge[2:]
    drop = np.concatenate([[False], two])
    names = np.where(np.concatenate([two, [False]]), mix(names + U(1)), names)[~drop]
    starts = starts[~drop]
    for level in (2, 3):
        left = (mix(names ^ power(level)) & U(1)).astype(bool)
        pair = left[:-1] & ~left[1:]
        joined = mix(names[:-1] * power(level) + names[1:] * power(level + 2))
        drop = np.concatenate([[False], pair])
        names = np.concatenate([np.where(pair, joined, names[:-1]), names[-1:]])[~drop]
        starts = starts[~drop]
    return names, starts


def ranks(words: np.ndarray) -> np.ndarray:
    grams = gram_hashes(words, SPAN)
    names, starts = recompress(words)
    at = starts - MARGIN
    ok = (at >= 0) & (at < len(grams))
    out = np.full(len(grams), TOP)
    out[at[ok]] = mix(grams[at[ok]] ^ names[ok]) >> U(1)
    return out


def finder(seed: int = 0) -> Finder:
    def pieces(raw):
        all_ = split(raw)
        return lambda a, b: b" ".join(all_[a:b])

    return Finder(partial(word_hashes, seed=seed), ranks, WINDOW, SPAN, pieces, compare_hashes, seed=seed)


def _report(raw, a, b):
    words = split(raw)
    kept = words if a is None else list(compress(words, ~covered(len(words), a, b)))
    text = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (the words that
    stay, joined by one space). A word goes if a window of 50 words that covers it also starts in a
    document with a smaller id. Null, empty and short texts lose nothing; see repeats() for ids.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return repeats(d, finder, _report, "n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).drop("kept_text")
