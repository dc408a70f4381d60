"""Words and shingles of many texts at once, as numpy arrays over one buffer of bytes."""

from __future__ import annotations

import functools

import numpy as np

#: Any odd number would do as the base of the rolling hash.
BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: equal values stay equal, all bits depend on all bits."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """A number for each byte value, without structure."""
    return mixed(np.arange(1, 257, dtype=np.uint64), 7)


class Powers:
    """Powers of BASE modulo 2**64 and of its inverse, as many as were asked for so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


class Words:
    """Words of texts, which are joined by single spaces, with a hash for every run of words.

    texts: bytes. text_of: the text of each word; starts, ends: its place in the buffer; first: the index of each
    text's first word, and the number of words at the end.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.text_of = np.repeat(np.arange(len(split)), counts)
        every = [w for words in split for w in words]
        buffer = np.frombuffer(b" ".join(every), np.uint8)
        lengths = np.fromiter(map(len, every), np.int64, len(every))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        up, self.down = Powers.of(len(buffer) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters()[buffer] * up[: len(buffer)])))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end: equal runs, wherever they are, have equal hashes."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each run of size words of a text, and the index of its first word."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text_of[:n] == self.text_of[size - 1 :])
        return self.hashes(self.starts[at], self.ends[at + size - 1]), at
