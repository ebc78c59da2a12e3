"""Suffix sorting by linear grouping (after U. Baier, 2016).

Phase 1 groups the suffixes by their Lyndon prefixes.  Groups start as letters and
are taken from the largest down.  Each suffix of the group finds the nearest place
before it whose group is smaller, by hopping over the pointers already known; that
suffix's prefix grows by the group's word, so it leaves its own group for a new
one just above, more copies of the word going further up.

Phase 2 walks the groups from the smallest: the suffix at hand tells which ones end right
before it, and these take the next free places of their groups, one after another
along the same pointers.  No names are given anew and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order; a suffix that is a prefix of another comes first."""
    n = len(letters)
    if not n:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(letters, kind="stable")
    ranked = letters[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(head, n))
    by_rank = np.empty(n, dtype=np.int64)
    by_rank[order] = np.repeat(head, size)
    seat = np.empty(n, dtype=np.int64)
    seat[order] = np.arange(n)
    sa, group, at = order.tolist(), by_rank.tolist(), seat.tolist()
    last = [0] * n  # of a group, by its first seat
    for h, s in zip(head.tolist(), size.tolist(), strict=True):
        last[h] = h + s - 1
    prev = list(range(-1, n - 1))

    top = n - 1
    while top >= 0:
        low = group[sa[top]]
        if low == top:
            i = sa[top]
            p = prev[i]
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:  # one parent: it moves to the end of its group, as a group of its own
                h = group[p]
                e = last[h]
                if e != h:
                    q, s = sa[e], at[p]
                    sa[s], sa[e], at[q], at[p] = q, p, s, e
                    group[p] = last[e] = e
                    last[h] = e - 1
            top -= 1
            continue
        times: dict[int, int] = {}
        for i in sa[low : top + 1]:
            p = prev[i]
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        top = low - 1
        if not times:
            continue
        levels: dict[int, list[int]] = {}
        for p, m in times.items():
            levels.setdefault(m, []).append(p)
        for m in sorted(levels, reverse=True):
            ends: dict[int, int] = {}
            moved = levels[m]
            for p in moved:
                h = group[p]
                e = ends.get(h, last[h])
                q, s = sa[e], at[p]
                sa[s], sa[e], at[q], at[p] = q, p, s, e
                ends[h] = e - 1
            for p in moved:
                group[p] = ends[group[p]] + 1
            for h, e in ends.items():
                last[e + 1] = last[h]
                if e >= h:
                    last[h] = e
    free = group[:]  # by suffix: its group's first seat; ``seats`` counts up from there
    seats = list(range(n))
    placed = [False] * n
    out = [0] * n
    i = n - 1
    while i >= 0 and not placed[i]:  # those that end at the end of the text
        g = free[i]
        out[seats[g]] = i
        seats[g] += 1
        placed[i] = True
        i = prev[i]
    for r in range(n):
        i = out[r] - 1
        while i >= 0 and not placed[i]:
            g = free[i]
            out[seats[g]] = i
            seats[g] += 1
            placed[i] = True
            i = prev[i]
    return np.array(out, dtype=np.int64)
