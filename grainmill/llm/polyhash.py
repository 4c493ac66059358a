"""Vectorised polynomial hashes of byte ranges.

For bytes b the prefix sums H[k] = sum(T[b_i] * r**i, i < k) mod 2**64 give every
range's hash as (H[end] - H[start]) * r**-start, mixed; equal ranges have equal
hashes wherever they stand. Two independent lanes make 128 bits.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def mix_one(x: int, y: int) -> int:
    """Two signed 64-bit integers as one."""
    pair = np.array([x, y], np.int64).view(np.uint64)
    return int((mix(pair[:1]) + pair[1:]).view(np.int64)[0])


class PolyHash:
    """One lane. Powers are kept and grown as longer buffers come."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _ONE
        self.base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = n + 65536
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, np.uint64(base & (2**64 - 1)))
                powers[0] = _ONE
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a uint8 array; one longer than it."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end)."""
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all ranges of a size, as ranges() has them."""
        return mix((prefix[size:] - prefix[:-size]) * self.down[: len(prefix) - size])


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text as bytes, and where its white-space separated words start and end.

    White space is exactly 0x20 and 0x09-0x0D."""
    data = np.frombuffer(text, np.uint8)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    return data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by single spaces, and their starts and ends in that."""
    joined = canonical(text)
    return joined, *word_ends(joined)


def canonical(text: bytes) -> bytes:
    """The words of a text joined by single spaces."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = data[keep]
    out[space[keep]] = 32
    return out.tobytes().rstrip(b" ")


def word_ends(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that are joined by single spaces."""
    if not joined:
        none = np.zeros(0, np.int64)
        return none, none
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
