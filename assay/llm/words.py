"""Words, word hashes and window hashes of many texts at once, inside a task.

Texts are UTF-8 byte strings. A batch is laid out in one buffer with a space after each text, and
words, their hashes and the hashes of runs of words come out of whole-array arithmetic. Hashes are
64-bit polynomials over random byte (or word) values, mixed at the end; users confirm on contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words: all but the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        table[lo:hi + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, for text with A-Z lower-cased
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def _values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Poly:
    """Polynomial hashes of all runs of one array: prefix sums of value times power."""

    def __init__(self, base: int, seed: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.values = _values(seed)
        self.up = self.down = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 1 << 16)
            for name, by in (("up", self.base), ("down", self.back)):
                steps = np.full(m, by, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        out = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Of all runs of ``k`` values, by their start."""
        n = len(prefix) - k
        return (prefix[k:] - prefix[:n]) * self.down[:n] if n > 0 else np.zeros(0, dtype=U64)


BYTES = Poly(0xD6E8FEB86659FD93, 11)
WORDS = Poly(0xA0761D6478BD642F, 12)
#: a second, independent pair; together they give 128 bits
BYTES2 = Poly(0xE7037ED1A0B428DB, 13)
WORDS2 = Poly(0x8EBC6AF09C88C6E3, 14)


class Words:
    """The words of a list of texts; word i covers bytes start[i]:end[i] of ``data``, text j has
    the words first[j]:first[j + 1] and begins at byte at[j]."""

    def __init__(self, texts: list[bytes | None], keep: np.ndarray, lower: bool = False):
        data = b" ".join([t or b"" for t in texts]) + b" "
        self.data = data.lower() if lower else data  # of bytes: A-Z only
        self.raw = data
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        size = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts))
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = keep[self.buf]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.at)

    def hashes(self, poly: Poly = BYTES) -> np.ndarray:
        prefix = poly.prefix(poly.values[self.buf])
        return mix(poly.runs(prefix, self.start, self.end) + (self.end - self.start).astype(U64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]]


def window_hashes(word_hashes: np.ndarray, k: int, poly: Poly = WORDS) -> np.ndarray:
    """Of all runs of ``k`` words, also of those that cross from one text to the next."""
    return mix(poly.windows(poly.prefix(word_hashes), k))


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For all n runs of ``k`` words: does the run stay within one text?"""
    ok = np.ones(n, dtype=bool)
    for end in first[1:-1]:
        ok[max(0, end - k + 1):end] = False
    return ok


def slices(sizes: list[int], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one row."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
