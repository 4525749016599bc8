"""Simple-8b: as many ids as fit go into one 64-bit word, of which four bits select their number and width.

Ids are coded in blocks of a fixed number of ids, each starting with a new word; the word at which each block starts is
kept, so blocks decode on their own. All blocks of a payload advance together, one word a step, in array operations. A
value over 60 bits is an escape: selector 0, whose word holds the place of the value in a list of plain 64-bit values.
"""

from __future__ import annotations

import numpy as np

BLOCK_IDS = 512
#: Ids to a word by selector; selector 0 is the escape.
IDS_OF_SELECTOR = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
PAYLOAD_BITS = 60
_IDS = np.array(IDS_OF_SELECTOR, np.int64)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at most one too many from 2**53 on."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _selectors(width: np.ndarray) -> np.ndarray:
    """For each place of each block (rows) the selector of a word that starts there.

    Where many ids fit into a word, fewer do as well, so the number of selectors that fit names the best one.
    """
    last = len(IDS_OF_SELECTOR) - 1
    most, seen = width, 1
    fitting = np.zeros(width.shape, np.uint8)
    for selector in range(last, 0, -1):
        count = IDS_OF_SELECTOR[selector]
        while seen < count:
            step = min(seen, count - seen)
            moved = most.copy()
            np.maximum(most[:, :-step], most[:, step:], out=moved[:, :-step])
            most = moved
            seen += step
        fitting += most <= PAYLOAD_BITS // count
    return np.where(fitting > 0, last + 1 - fitting, 0).astype(np.uint8)


def encode(values: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped values) of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block_ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    padded = np.zeros(blocks * block_ids, np.uint64)
    padded[:n] = values
    width = _widths(padded).reshape(blocks, block_ids)
    selector = _selectors(width).ravel()
    size = np.full(blocks, block_ids, np.int64)
    size[-1] = n - (blocks - 1) * block_ids
    base = np.arange(blocks) * block_ids
    starts = np.zeros(blocks * block_ids, bool)
    row, place = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        at = base[row] + place
        starts[at] = True
        place = place + _IDS[selector[at]]
        go = place < size[row]
        row, place = row[go], place[go]
    at = np.flatnonzero(starts)
    kind = selector[at]
    words = kind.astype(np.uint64) << np.uint64(PAYLOAD_BITS)
    # Past the end of a block a word holds zeros.
    guarded = np.zeros((blocks, block_ids + 60), np.uint64)
    guarded[:, :block_ids] = padded.reshape(blocks, block_ids)
    guarded, spot = guarded.ravel(), at + at // block_ids * 60
    for s in range(1, len(IDS_OF_SELECTOR)):
        of = np.flatnonzero(kind == s)
        bits = PAYLOAD_BITS // IDS_OF_SELECTOR[s]
        for k in range(IDS_OF_SELECTOR[s] if len(of) else 0):
            words[of] |= guarded[spot[of] + k] << np.uint64(k * bits)
    escaped = np.flatnonzero(kind == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(at, base), padded[at[escaped]]


def decode(
    words: np.ndarray, first_word: np.ndarray, escapes: np.ndarray, n: int, block_ids: int = BLOCK_IDS
) -> np.ndarray:
    """The ``n`` values coded by :func:`encode`."""
    out = np.zeros(n + 1, np.uint64)
    if not n:
        return out[:0]
    kind = (words >> np.uint64(PAYLOAD_BITS)).astype(np.int64)
    payload = words & np.uint64((1 << PAYLOAD_BITS) - 1)
    count = _IDS[kind]
    before = np.cumsum(count) - count
    block = np.repeat(np.arange(len(first_word)), np.diff(np.append(first_word, len(words))))
    at = before - before[first_word][block] + block * block_ids
    end = np.minimum((block + 1) * block_ids, n)
    for s in range(1, len(IDS_OF_SELECTOR)):
        of = np.flatnonzero(kind == s)
        bits = PAYLOAD_BITS // IDS_OF_SELECTOR[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(IDS_OF_SELECTOR[s] if len(of) else 0):
            to = at[of] + k
            out[np.where(to < end[of], to, n)] = payload[of] >> np.uint64(k * bits) & mask
    escaped = np.flatnonzero(kind == 0)
    out[at[escaped]] = escapes[payload[escaped].astype(np.int64)]
    return out[:n]
