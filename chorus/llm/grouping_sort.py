"""Suffix sorting by linear grouping construction.

Suffixes are grouped by their Lyndon prefix (the longest Lyndon word they
begin with), first by first symbol only.  Groups are taken in descending
order; every suffix of the group finds its previous smaller suffix, by way
of the pointers that higher groups have left, and the suffixes so pointed to
are lifted into new groups right above their own, those pointed to most
often highest.  When all groups are done, one ascending pass over the suffix
array emits each group's order: the suffix before each one emitted, and its
chain of previous smaller suffixes, take the next free places of their
groups.  Nothing is renamed and sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of integer symbols whose last one is the unique least."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1])))
    # groups are numbered as they come; ``below`` links each to the next lower one
    members = [m.tolist() for m in np.split(order, heads[1:])]
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(np.arange(len(members)), np.diff(np.append(heads, n)))
    group = group.tolist()
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    done = bytearray(len(members))
    previous = [-1] * n
    now = len(members) - 1
    while now >= 0:
        own = [s for s in members[now] if group[s] == now]
        members[now] = own
        if len(own) > 1:
            own.sort()
        times: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0:
                g = group[p]
                if g == now:
                    p = previous[p]
                    break
                if not done[g]:
                    break
                p = previous[p]
            previous[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                lifted: dict[int, list[int]] = {}
                for p in by_times[k]:
                    lifted.setdefault(group[p], []).append(p)
                for g, suffixes in lifted.items():
                    new = len(members)
                    members.append(suffixes)
                    done.append(0)
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    if up >= 0:
                        below[up] = new
                    for p in suffixes:
                        group[p] = new
        done[now] = 1
        now = below[now]
    # places: groups in ascending order
    start = [0] * len(members)
    g, at = 0, 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            placed[s] = 1
            s = previous[s]
    return np.array(out, dtype=np.int64)


def neighbour_matches(symbols: np.ndarray, order: np.ndarray, end: int) -> np.ndarray:
    """For each suffix the longest match with a neighbour in suffix order,
    counted up to the first symbol that is at most ``end``."""
    best = np.zeros(len(symbols), dtype=np.int64)
    a, b, t = order[:-1], order[1:], 0
    n = len(symbols)
    while len(a):
        ok = np.maximum(a, b) + t < n
        a, b = a[ok], b[ok]
        x = symbols[a + t]
        ok = (x == symbols[b + t]) & (x > end)
        a, b = a[ok], b[ok]
        t += 1
        best[a] = np.maximum(best[a], t)
        best[b] = np.maximum(best[b], t)
    return best
