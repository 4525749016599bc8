"""Suffix arrays by linear grouping.

The suffixes are first grouped by their longest Lyndon prefix, then each group is put in order; nothing is renamed or
solved again on a shorter text.

First phase: groups start as the suffixes with the same first symbol, in ascending order. From the highest group down,
each suffix of a group points to the nearest suffix before it that lies in a lower group. The Lyndon prefix of that one
goes on with the prefix of the group at hand, so it moves to the upper end of its own group, into a group of its own;
where the prefix follows several times over, higher still. Second phase: ascending through the emitted suffixes, each
one settles those whose Lyndon prefix ends where it starts: the one before it and what that one points to, in turn.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start places of the suffixes of ``symbols`` (whole numbers), in ascending order; a prefix comes before the longer."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    # The end of the text is a symbol below all others.
    text = np.append(symbols, symbols.min() - 1)
    n += 1
    placed = np.argsort(text, kind="stable")
    ordered = text[placed]
    opens = np.append(True, ordered[1:] != ordered[:-1])
    starts = np.flatnonzero(opens)
    of = np.empty(n, np.int64)
    of[placed] = starts[np.cumsum(opens) - 1]
    size = np.zeros(n + 1, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    at = np.empty(n, np.int64)
    at[placed] = np.arange(n)
    order, where, group, size = placed.tolist(), at.tolist(), of.tolist(), size.tolist()
    lower = [-1] * n

    i = n - 1
    while i > 0:
        g = group[order[i]]
        if g == i:
            s = order[i]
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = lower[p]
            lower[s] = p
            if p >= 0:
                h = group[p]
                left = size[h] - 1
                if left:
                    last = h + left
                    q, here = order[last], where[p]
                    order[here], where[q] = q, here
                    order[last], where[p] = p, last
                    size[h], size[last], group[p] = left, 1, last
            i -= 1
            continue
        times: dict[int, int] = {}
        for s in sorted(order[g : i + 1]):
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = lower[p]
            lower[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, m in times.items():
            by_times.setdefault(m, []).append(p)
        for m in sorted(by_times, reverse=True):
            moved = [(p, group[p]) for p in by_times[m]]
            for p, h in moved:
                left = size[h] - 1
                size[h] = left
                last = h + left
                q, here = order[last], where[p]
                order[here], where[q] = q, here
                order[last], where[p] = p, last
            fresh: dict[int, int] = {}
            for p, h in moved:
                fresh[h] = fresh.get(h, 0) + 1
                group[p] = h + size[h]
            for h, count in fresh.items():
                size[h + size[h]] = count
        i = g - 1

    # The suffix of the end alone is the least; each group fills from its front.
    front = list(range(n))
    result, done = [0] * n, [False] * n
    result[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = result[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            result[front[g]] = s
            front[g] += 1
            done[s] = True
            s = lower[s]
    return np.array(result[1:], np.int64)
