"""Word hashing for tasks that see whole texts."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """Word -> unsigned XXH64, computed once per distinct word. The memory is
    bounded: beyond ``limit`` words it starts afresh."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class ByteWords:
    """Hashes of all words of a batch of texts at once, without a Python step per word.

    A word's hash is that of its bytes as a polynomial modulo 2**64: sums over the
    whole batch differ by the word, shifted back to the word's start, and mixed.
    Words are parted at 0x20 and 0x09-0x0D; letters are in lower case."""

    SPACE = np.zeros(256, bool)
    SPACE[[32, 9, 10, 11, 12, 13]] = True

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, its line): lines are counted through all texts, each text beginning a new one."""
        data = np.frombuffer("\n".join(texts).lower().encode("utf-8", "surrogatepass"), np.uint8)
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        while len(data) > len(self.up):
            n = np.uint64(len(self.up))
            more = [t * np.multiply.reduce(np.full(len(t), b, np.uint64)) for t, b in ((self.up, _BASE), (self.down, _INVERSE))]
            self.up, self.down = np.concatenate((self.up, more[0])), np.concatenate((self.down, more[1]))
            assert len(self.up) == 2 * int(n)
        space = self.SPACE[data]
        edge = np.diff(space.view(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_BASE)
        h ^= h >> np.uint64(32)
        return h, np.searchsorted(np.flatnonzero(data == 10), start)
