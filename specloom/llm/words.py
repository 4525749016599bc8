"""Ids of whole texts from ids of their distinct words, inside a task.

Words repeat far more often than texts do. A batch is split into words by array operations, each distinct word is encoded
once and remembered, and the ids are gathered back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from specloom.llm.shingles import powers

#: Bytes worked on at once; a longer text is cut at word boundaries.
SLAB_BYTES = 1 << 20
#: Distinct words a worker remembers before it forgets those it has not met again.
CACHE_WORDS = 700_000
LONG_WORD = 64
_BYTE = np.random.RandomState(7).randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def safe_cuts(raw: np.ndarray, size: int, blank: np.ndarray) -> list[int]:
    """Places about ``size`` bytes apart before an ASCII blank that follows a non-blank; ``blank``: by byte.

    A word never goes over such a place, whatever stands on either side. A stretch without one stays whole.
    """

    def places(part: np.ndarray) -> np.ndarray:
        is_blank = blank[part]
        return np.flatnonzero(is_blank[1:] & ~is_blank[:-1] & (part[:-1] < 128)) + 1

    cuts, at = [], 0
    while len(raw) - at > size:
        found = None
        for step in (min(1 << 16, size), size):
            lo = at + size - step
            good = places(raw[lo : at + size + 1])
            if len(good):
                found = lo + int(good[-1])
                break
        if found is None or found <= at:
            good = places(raw[at + size :])
            if not len(good):
                break
            found = at + size + int(good[0])
        cuts.append(found)
        at = found
    return cuts


class WordIds:
    """Encodes columns of text word by word; subclasses say where words start and what their ids are."""

    #: Texts holding one of these are one word.
    special: list[bytes] = []
    #: ASCII blanks before which a word always starts, if they follow another byte.
    blanks = b" "

    def __init__(self, slab_bytes: int = SLAB_BYTES, cache_words: int = CACHE_WORDS):
        self.slab_bytes, self.cache_words = slab_bytes, cache_words
        self.blank = np.zeros(256, bool)
        self.blank[list(self.blanks)] = True
        self._forget()

    def word_starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Offsets at which words start; bounds: those of the texts, which also start words."""
        raise NotImplementedError

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word: their numbers, and the ids one after the other."""
        raise NotImplementedError

    def _forget(self) -> None:
        # Keys of words in ascending order, and the slots at which their ids are kept.
        self.ordered, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.first, self.length = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)
        self.keys, self.slabs = np.empty(1 << 18, np.uint64), np.empty(1 << 18, np.int32)

    def _forget_rare(self) -> None:
        """Keep the words met in two slabs or more, if they fill less than half of the cache."""
        n = len(self.slots)
        kept = np.flatnonzero(self.slabs[:n] > 1)
        if len(kept) * 2 > self.cache_words:
            kept = kept[self.slabs[kept] > np.median(self.slabs[kept])]
        size, first, keys = self.length[kept].astype(np.int64), self.first[kept], self.keys[kept]
        flat = self.flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self._forget()
        self._store(keys, size, flat)
        self.slabs[: len(kept)] = 1

    def _slab(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the slab its slot in the cache, and for each text its first word."""
        power, inverse = powers(len(raw))
        start = self.word_starts(raw, bounds)
        end = np.append(start[1:], len(raw))
        size = end - start
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
            key = (total[end] - total[start]) * inverse[start]
            key ^= key >> np.uint64(29)
            key += size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        raw_bytes = raw.tobytes()
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            key[i] = np.uint64(hash(raw_bytes[start[i] : end[i]]) & 0xFFFFFFFFFFFFFFFF)
        codes, distinct = pd.factorize(key)
        if len(self.slots) + len(distinct) > self.cache_words:
            self._forget_rare()
        slot = np.full(len(distinct), -1, np.int64)
        if len(self.ordered):
            spot = np.minimum(np.searchsorted(self.ordered, distinct), len(self.ordered) - 1)
            slot = np.where(self.ordered[spot] == distinct, self.slots[spot], -1)
        new = np.flatnonzero(slot < 0)
        if len(new):
            where = np.empty(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            where = where[new]
            words = [raw_bytes[a:b].decode("utf-8", "replace") for a, b in zip(start[where].tolist(), end[where].tolist())]
            slot[new] = self._store(distinct[new], *self.word_ids(words))
        self.slabs[slot] += 1
        return slot[codes], np.searchsorted(start, bounds)

    def _store(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        n = len(self.slots)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.int32)])
        while n + len(keys) > len(self.first):
            for name in ("first", "length", "keys", "slabs"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.empty(len(old), old.dtype)]))
        new = slice(n, n + len(keys))
        self.flat[self.used : self.used + len(flat)] = flat
        self.first[new] = self.used + np.cumsum(size) - size
        self.length[new], self.keys[new], self.slabs[new] = size, keys, 0
        self.used += len(flat)
        slots = np.arange(n, n + len(keys))
        all_keys, all_slots = np.concatenate([self.ordered, np.sort(keys)]), np.concatenate([self.slots, slots[np.argsort(keys)]])
        order = np.argsort(all_keys, kind="stable")
        self.ordered, self.slots = all_keys[order], all_slots[order]
        return slots

    def _pieces(self, raw: np.ndarray, bounds: np.ndarray):
        """Slabs: (from text, to text, bytes, bounds within, whether its last text ends here).

        A text over a slab's size comes in several.
        """
        i, n = 0, len(bounds) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + self.slab_bytes, "right")) - 1)
            part = raw[bounds[i] : bounds[j]]
            if len(part) <= self.slab_bytes or any(s in part.tobytes() for s in self.special):
                yield i, j, part, bounds[i : j + 1] - bounds[i], True
            else:
                at = [0, *safe_cuts(part, self.slab_bytes, self.blank), len(part)]
                for a, b in zip(at, at[1:]):
                    yield i, j, part[a:b], np.array([0, b - a]), b == len(part)
            i = j

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        raw, bounds = text_buffers(column)
        out = np.zeros(len(bounds) - 1, np.int64)
        for i, j, part, inner, _ in self._pieces(raw, bounds):
            if len(part):
                slot, word = self._slab(part, inner)
                total = np.concatenate([[0], np.cumsum(self.length[slot], dtype=np.int64)])
                out[i:j] += np.diff(total[word])
        return out

    def encode(self, column: pa.Array):
        """Yield (ids, bounds of texts within them) for consecutive texts."""
        raw, bounds = text_buffers(column)
        held: list[np.ndarray] = []
        for _, _, part, inner, last in self._pieces(raw, bounds):
            ids, edge = np.empty(0, np.int32), np.zeros(len(inner), np.int64)
            if len(part):
                slot, word = self._slab(part, inner)
                size = self.length[slot].astype(np.int64)
                total = np.concatenate([[0], np.cumsum(size)])
                ids = self.flat[np.repeat(self.first[slot] - total[:-1], size) + np.arange(total[-1])]
                edge = total[word]
            held.append(ids)
            if last:
                ids = np.concatenate(held)
                yield ids, (edge if len(held) == 1 else np.array([0, len(ids)]))
                held = []
