"""Hashes of words, and polynomial hashes of byte and word sequences with numpy, modulo 2**64.

Words go by XXH3. Polynomial hashes modulo 2**64 have known collisions, so what they find equal is compared again by
the operators: over the bytes themselves or by a cryptographic digest of them."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
_MASK = (1 << 64) - 1
#: Odd base of the polynomial, and a random odd value for each byte, both drawn from a fixed seed.
BASE = 0x9E3779B97F4A7C17
_TABLE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def power(n: int) -> np.uint64:
    return U(pow(BASE, int(n), 1 << 64))


class Powers:
    """BASE**i and its inverse for i up to the longest sequence seen so far."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n >= len(self.up):
            size = 1 << int(n).bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                a = np.full(size + 1, U(base), np.uint64)
                a[0] = U(1)
                setattr(self, name, np.multiply.accumulate(a))


_POWERS = Powers()


class Prefix:
    """Prefix hashes of a sequence of 64-bit values: the hash of any [a, b) in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        _POWERS.upto(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _POWERS.up[:n], out=self.sums[1:])

    def span(self, a, b) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * _POWERS.down[a]


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _TABLE[raw]


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values, mixed, by doubling."""
    have = {1: values}
    n = 1
    while n * 2 <= k:
        h = have[n]
        m = len(h) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        have[n * 2] = h[:m] + h[n:] * power(n)
        n *= 2
    out, done = None, 0
    for n in sorted(have, reverse=True):
        if k & n:
            if out is None:
                out = have[n]
            else:
                m = len(values) - done - n + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:m] + have[n][done : done + m] * power(done)
            done += n
    return mix(out)


def words(raw: np.ndarray, lower: bool = False) -> list[bytes]:
    """Words of a text's bytes: what space and \\x09 to \\x0D separate, with A-Z lower-cased on demand."""
    data = raw.tobytes()
    return (data.lower() if lower else data).split()  # of bytes, both look at ASCII only


def word_hashes(raw: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """XXH3 of each word, 64 bits; only words' own bytes and the seed enter it."""
    all_ = words(raw, lower)
    return np.fromiter(map(xxh3_64_intdigest, all_, repeat(seed)), np.uint64, len(all_))


def texts(column):
    """The bytes of each text of an Arrow column of strings; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]
