"""Vectorised scans of UTF-8 text blocks: words, word hashes, shingles. A word is a run of bytes outside space and 0x09-0x0D, unless another
table of the bytes between words is given."""

from __future__ import annotations

import numpy as np

_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Between terms: all ASCII but digits and letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_A = _U(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        base, inverse = np.full(size, _P), np.full(size, _PINV)
        base[0] = inverse[0] = 1
        _powers[size] = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers[size]


class Words:
    """Words of a block of texts. ``start``/``end``: byte spans; ``doc``: row of each word; ``first``: n_docs+1 word offsets."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        inside = ~between[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # a word never crosses from one text to the next
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z folded to a-z if ``fold``), the same wherever the word stands."""
        n = len(self.raw)
        if not len(self.start):
            return np.zeros(0, _U)
        power, inverse = _power_tables(n)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[LOWER[self.raw] if fold else self.raw] * power[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(_U))


def hash_of(spelt: list[str]) -> np.ndarray:
    """The hashes of these words as ``Words.hashes`` gives them, letters as they stand."""
    raw = np.frombuffer(" ".join(spelt).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in spelt])
    words = Words(raw, np.array([0, len(raw)]))
    if len(words.start) != len(spelt) or (len(spelt) and (words.end != ends - 1).any()):
        raise ValueError("words must not be empty or hold white space")
    return words.hashes()


class Vocabulary:
    """Words by number, looked up for a whole block by their hashes; words of the vocabulary itself must hash apart."""

    def __init__(self, spelt: list[str]):
        hashed = hash_of(spelt)
        self.order = np.argsort(hashed)
        self.sorted = hashed[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two words of the vocabulary have one hash")

    def ids(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        if not len(self.sorted) or not len(hashed):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashed), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashed, self.order[at], -1)


def windows(words: Words, hashed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within a text, and the word at which each begins."""
    n = len(hashed)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    acc = hashed[: n - k + 1].copy()
    for i in range(1, k):
        acc = acc * _A + hashed[i : n - k + 1 + i]
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return mix(acc[at]), at


def shingle_sets(words: Words, hashed: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word windows; a text of 1 to k-1 words has its whole sequence as one; else empty."""
    out, (win, at) = [], windows(words, hashed, k)
    first = np.searchsorted(at, words.first)
    for d in range(len(words.offsets) - 1):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= k:
            s = np.sort(win[first[d] : first[d + 1]])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            acc = _U(b - a) * _BYTE[:1]
            for h in hashed[a:b]:
                acc = acc * _A + h
            out.append(mix(acc))
        else:
            out.append(np.zeros(0, _U))
    return out
