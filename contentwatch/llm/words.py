"""Vectorised word hashing: whole batches of texts as numpy arrays, with no Python per word.

A word's hash is a polynomial over its bytes (A-Z lower-cased) modulo 2^64, read off one running sum per
block, and mixed.  Equal words have equal hashes wherever they stand; different ones differ but for chance
(about n^2 / 2^65 for n distinct words).
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a longer word makes a longer block.
BLOCK = 1 << 18
_BASE, _INVERSE = 6364136223846793005, pow(6364136223846793005, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all (Steele, Lea & Flood 2014)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Hashes the words of texts; ``separators``: the bytes between words; ``fold``: A-Z equal a-z; another ``seed``: another hash."""

    def __init__(self, separators: bytes, fold: bool = True, seed: int = 0):
        self.word = np.ones(256, bool)
        self.word[np.frombuffer(separators, np.uint8)] = False
        self.separators = separators
        lower = np.arange(256)
        lower[65:91] += 32 * fold
        self.value = mix(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[lower]
        self.grow(BLOCK + 2)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(n, _INVERSE, np.uint64))

    def _cuts(self, text: bytes) -> list[bytes]:
        """A long text in blocks that end between words."""
        parts, start = [], 0
        while len(text) - start > BLOCK:
            stop = start + BLOCK
            chunk = np.frombuffer(text, np.uint8, BLOCK, start)
            between = np.flatnonzero(~self.word[chunk])
            if len(between):
                stop = start + int(between[-1])
            else:
                rest = np.flatnonzero(~self.word[np.frombuffer(text, np.uint8, len(text) - stop, stop)])
                stop = stop + int(rest[0]) if len(rest) else len(text)
            stop = max(stop, start + 1)
            parts.append(text[start:stop])
            start = stop
        parts.append(text[start:])
        return parts

    def blocks(self, texts: list[bytes]):
        """(indices of texts, joined bytes, starts of the parts) for blocks of about BLOCK bytes."""
        at, parts, held = [], [], 0
        for i, text in enumerate(texts):
            for part in self._cuts(text) if len(text) > BLOCK else (text,):
                if parts and held + len(part) >= BLOCK:
                    yield at, parts
                    at, parts, held = [], [], 0
                at.append(i)
                parts.append(part)
                held += len(part) + 1
        if parts:
            yield at, parts

    def spans(self, parts: list[bytes]):
        """(bytes as an array, starts, ends of words, index of each word's part)."""
        gap = self.separators[:1]
        data = np.frombuffer(gap.join(parts) + gap, np.uint8)
        is_word = self.word[data]
        edges = np.flatnonzero(np.diff(is_word, prepend=False))
        starts, ends = edges[0::2], edges[1::2]
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        return data, starts, ends, np.searchsorted(begins, starts, side="right") - 1

    def hash_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.power):
            self.grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, offsets: text i has words offsets[i] to offsets[i + 1])."""
        hashes, counts = [], np.zeros(len(texts), np.int64)
        for at, parts in self.blocks(texts):
            data, starts, ends, part = self.spans(parts)
            hashes.append(self.hash_spans(data, starts, ends))
            np.add.at(counts, np.asarray(at), np.bincount(part, minlength=len(parts)))
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), offsets


def grams_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the runs of k words that start at the words ``at``."""
    found = np.zeros(len(at), np.uint64)
    for j in range(k):
        found *= np.uint64(_BASE)
        found += hashes[at + j]
    return mix(found)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; entry i is the run that starts at word i (the last k - 1 are missing)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for j in range(k):
        found *= np.uint64(_BASE)
        found += hashes[j : j + n]
    return mix(found)
