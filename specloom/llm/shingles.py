"""Sets of hashed word shingles of whole texts, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

#: Bytes hashed at once; a text beyond that is hashed alone.
SLAB_BYTES = 1 << 20
#: A word of more bytes is hashed by a digest: sums modulo 2**64 clash for some long words that are easily made.
LONG_WORD = 64
BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.RandomState(11).randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base up to ``n``, and their inverses modulo 2**64; those of a slab stay, of a longer text not."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    most = max(n, SLAB_BYTES) + 1
    with np.errstate(over="ignore"):
        found = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, np.uint64(b))]), dtype=np.uint64)
            for b in (BASE, pow(BASE, -1, 1 << 64))
        ]
    if n <= SLAB_BYTES:
        _powers[:] = found
    return found[0], found[1]


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and, for each text, its first word."""
    word = ~_BLANK[raw]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    opens[edges] = word[edges]
    start = np.flatnonzero(opens)
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    closes[edges[edges > 0] - 1] = word[edges[edges > 0] - 1]
    closes[-1] = word[-1]
    end = np.flatnonzero(closes) + 1
    power, inverse = powers(len(raw))
    lowered = _LOWER[raw]
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[lowered] * power[: len(raw)], out=total[1:])
        hashes = _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        digest = hashlib.blake2b(lowered[start[i] : end[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes, np.searchsorted(start, bounds)


def word_counts(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes and their numbers in some texts."""
    hashes = [np.empty(0, np.uint64)]
    for _, _, part, inner in _slabs(raw, bounds):
        if len(part):
            hashes.append(_word_hashes(part, inner)[0])
    return np.unique(np.concatenate(hashes), return_counts=True)


class Weights:
    """Weights of words: the logarithms of their known counts, and 0 for all other words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.logs = words[order], np.log2(counts[order] + 1.0)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        codes, distinct = pd.factorize(hashes)
        if not len(self.words) or not len(distinct):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        return np.where(self.words[at] == distinct, self.logs[at], 0.0)[codes]


def _slabs(raw: np.ndarray, bounds: np.ndarray):
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLAB_BYTES, "right")) - 1)
        yield i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int, weights: Weights | None = None):
    """Yield for each text its sorted distinct shingle hashes: ``words`` words each; fewer words make one shingle.

    With ``weights`` each comes with the weights of its shingles, sums over their words.
    """
    empty, nothing = np.empty(0, np.uint64), np.empty(0)
    for i, j, part, inner in _slabs(raw, bounds):
        if not len(part):
            for _ in range(i, j):
                yield empty if weights is None else (empty, nothing)
            continue
        hashes, first = _word_hashes(part, inner)
        count = max(0, len(hashes) - words + 1)
        with np.errstate(over="ignore"):
            grams = np.zeros(count, np.uint64)
            for k in range(words):
                grams = _mixed(grams * np.uint64(BASE) + hashes[k : k + count] + np.uint64(k))
        if weights is not None:
            weight = weights.of(hashes)
            sums = sum(weight[k : k + count] for k in range(words))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                if weights is None:
                    yield np.unique(grams[a : b - words + 1])
                else:
                    one, at = np.unique(grams[a : b - words + 1], return_index=True)
                    yield one, sums[a:][at]
            elif b > a:
                short = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        short = _mixed(np.array([short * np.uint64(BASE) + h]))[0]
                one = np.array([short], np.uint64)
                yield one if weights is None else (one, np.zeros(1))
            else:
                yield empty if weights is None else (empty, nothing)
