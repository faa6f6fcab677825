"""Hashes of words and of runs of words, for many texts at once, in numpy.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(``[^\\x20\\x09-\\x0D]+`` on UTF-8).  Word hashes are a polynomial over random
byte values, mixed; hashes of n consecutive words are a polynomial over word
hashes, mixed.  Both are 64 bit and depend on nothing but the words, so every
task on every machine computes the same values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (public-domain splitmix64 constants)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Family:
    """Byte values, multipliers and grown power tables of one hash function."""

    def __init__(self, seed: int):
        base = mix(np.arange(1, 259, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
        self.bytes = base[:256]
        self.p, self.q = int(base[256]) | 1, int(base[257]) | 1
        self._tables = {}

    def powers(self, multiplier: int, n: int) -> np.ndarray:
        got = self._tables.get(multiplier)
        if got is None or len(got) < n:
            steps = np.full(max(n, 1 << 16), multiplier, U)
            steps[0] = 1
            got = self._tables[multiplier] = np.multiply.accumulate(steps)
        return got[:n]


FAMILIES = tuple(_Family(s) for s in (0x2545F4914F6CDD1D, 0x6A09E667F3BCC909))


def spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of each word of a buffer."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(buffer) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[buffer], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hash_words(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of every word; works through the buffer in chunks that end between words."""
    f, out, at = FAMILIES[family], np.empty(len(starts), U), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        powers = f.powers(f.p, hi - lo)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(f.bytes[buffer[lo:hi]] * powers, out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        value = (sums[e] - sums[s]) * f.powers(_inverse(f.p), hi - lo)[s]
        out[at:stop] = mix(value + (e - s).astype(U) * U(0x9E3779B97F4A7C15))
        at = stop
    return out


def hash_runs(words: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hash of words i .. i+n-1 for every i; empty if there are fewer than n words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    f = FAMILIES[family]
    out, at = np.empty(count, U), 0
    while at < count:
        stop = min(count, at + _CHUNK)
        part = words[at:stop + n - 1]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * f.powers(f.q, len(part)), out=sums[1:])
        out[at:stop] = mix((sums[n:] - sums[:-n]) * f.powers(_inverse(f.q), stop - at))
        at = stop
    return out


def sequence_hash(words: np.ndarray, first: np.ndarray, last: np.ndarray, family: int = 0) -> np.ndarray:
    """Hash of the words first .. last-1 for each pair of bounds (0 for none)."""
    f = FAMILIES[family]
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * f.powers(f.q, len(words)), out=sums[1:])
    inverse = f.powers(_inverse(f.q), len(words) + 1)
    value = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U))
    return np.where(last > first, value, U(0))


class Texts:
    """Words of several texts: ``words`` holds their hashes, ``bounds[d]`` is
    the first word of text d, ``doc[w]`` the text of word w."""

    def __init__(self, texts: list[bytes], family: int = 0):
        self.data = b"\n".join(texts)
        self.buffer = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
        self.starts, self.ends = spans(self.buffer)
        self.words = hash_words(self.buffer, self.starts, self.ends, family)
        self.bounds = np.searchsorted(self.starts, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def rehash(self, family: int) -> np.ndarray:
        return hash_words(self.buffer, self.starts, self.ends, family)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return self.bounds[self.doc + 1] - np.arange(len(self.words))


def batches(texts: list[bytes], limit: int = 1 << 20):
    """(first, texts) slices of at most ``limit`` bytes, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]
