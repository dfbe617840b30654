"""Suffix arrays of many strings at once by induced sorting, in numpy.

All strings lie in one array, each ended by its only 0. Every step of the two induction scans handles
the same place of every string's array, so the scans' sequential order is kept in each string while
numpy works across them. Strings must come longest first.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(t: np.ndarray, off: np.ndarray) -> np.ndarray:
    """t: symbols (int32) of all strings, string b from off[b] to off[b + 1]. Returns their sorted suffixes, as places in t, in the same layout."""
    n, strings = len(t), len(off) - 1
    lens = np.diff(off)
    sid = np.repeat(np.arange(strings, dtype=np.int32), lens)
    at = np.arange(n, dtype=np.int32)
    last = np.zeros(n, bool)
    last[off[1:] - 1] = True

    # A suffix is S if it is smaller than the next one: by the first symbol after the run of equal ones.
    same = np.append(t[:-1] == t[1:], False) & ~last
    less = np.append(t[:-1] < t[1:], True) | last
    runs_end = np.minimum.accumulate(np.where(same, n, at)[::-1])[::-1]
    small = less[runs_end]
    leftmost = small & ~np.concatenate([[True], small[:-1]])
    leftmost[off[:-1]] = False

    # Buckets: of each string and symbol, in order of string and symbol, hence in order of place.
    widths = np.maximum.reduceat(t, off[:-1]) + 1
    bucket = ((np.cumsum(widths) - widths)[sid] + t).astype(np.int32)
    sizes = np.bincount(bucket, minlength=int(widths.sum())).astype(np.int32)
    ends = np.cumsum(sizes, dtype=np.int32)
    starts = ends - sizes
    alive = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left").tolist()  # strings longer than i
    first, stop = off[:-1].astype(np.int32), (off[1:] - 1).astype(np.int32)
    # The suffix that each one induces in either scan, -1 for none; place n stands for a slot that is still empty.
    before = np.append(at - 1, -1).astype(np.int32)
    before[off[:-1]] = -1
    large_before, small_before = (np.where((before >= 0) & (small[before] == kind), before, -1).astype(np.int32) for kind in (False, True))

    def induced(order: np.ndarray) -> np.ndarray:
        """All suffixes from the leftmost small ones in this order (string by string)."""
        sa = np.full(n, n, np.int32)
        b = bucket[order]
        by = np.argsort(b, kind="stable")
        b = b[by]
        group = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        counts = np.diff(np.append(group, len(b)))
        sa[ends[b] - np.repeat(counts, counts) + np.arange(len(b)) - np.repeat(group, counts)] = order[by]
        free = starts.copy()
        for i, m in enumerate(alive):
            q = large_before[sa[first[:m] + i]]
            q = q[q >= 0]
            k = bucket[q]
            to = free[k]
            sa[to] = q
            free[k] = to + 1
        free = ends.copy()
        for i, m in enumerate(alive):
            q = small_before[sa[stop[:m] - i]]
            q = q[q >= 0]
            k = bucket[q]
            to = free[k] - 1
            sa[to] = q
            free[k] = to
        return sa

    places = np.flatnonzero(leftmost).astype(np.int32)
    if not len(places):
        return induced(places)
    sa = induced(places)
    ranked = sa[leftmost[sa]]

    # Names: equal substrings up to the next such place share one.
    number = np.zeros(n, np.int32)
    number[places] = np.arange(len(places))
    following = np.append(places[1:], places[-1])
    length = np.where(last[places], 1, following - places + 1)
    a, b = ranked[:-1], ranked[1:]
    la, lb = length[number[a]], length[number[b]]
    equal = (sid[a] == sid[b]) & (la == lb)
    live, k = np.flatnonzero(equal), 0
    while len(live):
        ok = t[a[live] + k] == t[b[live] + k]
        equal[live[~ok]] = False
        k += 1
        live = live[ok & (la[live] > k)]
    name = np.concatenate([[0], np.cumsum(~equal)])
    own = sid[ranked]
    begins = np.searchsorted(own, np.arange(strings))
    counts = np.diff(np.append(begins, len(own)))
    name = name - name[np.minimum(begins, len(name) - 1)][own]
    distinct = np.zeros(strings, np.int64)
    np.maximum.at(distinct, own, name + 1)
    again = np.flatnonzero((distinct < counts) & (counts > 0))
    if len(again):
        again = again[np.argsort(-counts[again], kind="stable")]
        by_place = np.zeros(len(places), np.int32)
        by_place[number[ranked]] = name
        # Places stand string by string too, at the same offsets as ranked ones.
        rows = [np.arange(begins[s], begins[s] + counts[s]) for s in again]
        flat = np.concatenate(rows)
        inner_off = np.concatenate([[0], np.cumsum(counts[again])])
        inner = suffix_arrays(by_place[flat], inner_off)
        ranked = ranked.copy()
        ranked[flat] = places[flat[inner]]
    return induced(ranked)
