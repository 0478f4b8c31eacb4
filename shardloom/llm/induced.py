"""Suffix arrays by induced sorting, for many strings at once, and their permuted common prefixes.

Every string is a lane of a (positions, lanes) array, so one numpy operation does the same step in all lanes.
A suffix is known by its flat index, position * lanes + lane.  Suffixes are classified, the leftmost-smaller
(LMS) substrings are sorted by induction and named, equal names are resolved by the same procedure on the
strings of names, and the whole array is induced from the sorted LMS suffixes.  All comparisons are of the
symbols themselves.
"""

from __future__ import annotations

import numpy as np


def equal_spans(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, lanes: int) -> np.ndarray:
    """Whether `size` symbols from a and from b (flat indices) are the same."""
    same = np.ones(len(a), bool)
    live, t = np.flatnonzero(size > 0), 0
    while len(live):
        step = t * lanes
        ok = text[a[live] + step] == text[b[live] + step]
        same[live[~ok]] = False
        t += 1
        live = live[ok & (size[live] > t)]
    return same


def suffix_arrays(text: np.ndarray, size: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix arrays of many strings: (positions, lanes), flat indices in suffix order; -1 beyond a string's size.

    text: (positions, lanes) symbols below `symbols`, 0 only as the last symbol of each string; size: their lengths.
    """
    n, lanes = text.shape
    total = n * lanes
    lane = np.arange(lanes)
    inside = np.arange(n)[:, None] < size
    flat = np.ascontiguousarray(text).reshape(-1)
    # A suffix is small (S) if it is less than the next one; equal first symbols look further right.
    step = np.zeros((n, lanes), np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[size - 1, lane] = 1
    where = np.where(step != 0, np.arange(n, dtype=np.int32)[:, None], np.int32(n - 1))
    where = np.minimum.accumulate(where[::-1], axis=0)[::-1]
    small = (np.take_along_axis(step, where, axis=0) > 0) & inside
    del step, where
    lms = small.copy()
    lms[0] = False
    lms[1:] &= ~small[:-1]
    code = (text.astype(np.int64) * lanes + lane).reshape(-1)
    count = np.bincount(code[inside.reshape(-1)], minlength=symbols * lanes).reshape(symbols, lanes)
    ends = np.cumsum(count, axis=0)
    head = np.concatenate((((ends - count) * lanes + lane).reshape(-1), total + lane))
    tail = np.concatenate(((ends * lanes + lane).reshape(-1), 2 * total + lane))
    # The bucket that the suffix before each one goes to; what has none, or one of the other kind, goes to a spare bucket.
    spare = symbols * lanes + lane
    to_large = np.broadcast_to(spare, (n + 1, lanes)).copy()
    to_small = to_large.copy()
    before, kind = code.reshape(n, lanes)[:-1], small[:-1]
    valid = inside[1:]
    np.copyto(to_large[1:n], before, where=valid & ~kind)
    np.copyto(to_small[1:n], before, where=valid & kind)
    to_large, to_small = to_large.reshape(-1), to_small.reshape(-1)
    empty = np.tile(total + lane, 2 * n)

    def induce(order: np.ndarray) -> np.ndarray:
        """The array induced from LMS suffixes (flat) given lane by lane in order of suffix."""
        sa = empty.copy()
        bucket = code[order]
        by = np.argsort(bucket, kind="stable")
        bucket = bucket[by]
        last = np.searchsorted(bucket, bucket, side="right")
        sa[tail[bucket] - (last - np.arange(len(by))) * lanes] = order[by]
        put = head.copy()
        for j in range(n):
            f = sa[j * lanes : (j + 1) * lanes]
            b = to_large[f]
            at = put[b]
            sa[at] = f - lanes
            put[b] = at + lanes
        # Every small suffix is written before it is read: the one after it is greater.
        put = tail.copy()
        for j in range(n - 1, -1, -1):
            f = sa[j * lanes : (j + 1) * lanes]
            b = to_small[f]
            at = put[b] - lanes
            sa[at] = f - lanes
            put[b] = at
        return sa[:total]

    by_lane = np.flatnonzero(np.ascontiguousarray(lms.T).reshape(-1))
    first_lane, pos = by_lane // n, by_lane % n
    place = pos * lanes + first_lane
    m = np.bincount(first_lane, minlength=lanes)
    first = np.concatenate(([0], np.cumsum(m)))
    rank = np.zeros(total, np.int32)
    rank[place] = np.arange(len(place)) - first[first_lane]
    width = np.diff(pos, append=0) + 1
    width[first[1:][m > 0] - 1] = 1
    span = np.zeros(total, np.int32)
    span[place] = width

    marked = np.append(lms.reshape(-1), np.zeros(lanes, bool))
    found = np.ascontiguousarray(induce(place).reshape(n, lanes).T).reshape(-1)
    found = found[marked[found]]
    # LMS substrings in order, lane by lane; the first of each lane is the end of its string.
    fresh = np.ones(len(found), bool)
    alike = np.flatnonzero((found[1:] % lanes == found[:-1] % lanes) & (span[found[1:]] == span[found[:-1]])) + 1
    fresh[alike] = ~equal_spans(flat, found[alike], found[alike - 1], span[found[alike]], lanes)
    name = np.cumsum(fresh)
    owner = found % lanes
    name -= name[first[owner]]
    names = np.zeros(lanes, np.int64)
    np.maximum.at(names, owner, name + 1)
    order = found.copy()
    hard = np.flatnonzero(names < m)
    if len(hard):
        most = int(m[hard].max())
        at = np.full(lanes, -1)
        at[hard] = np.arange(len(hard))
        pick = at[owner] >= 0
        reduced = np.zeros((most, len(hard)), np.int32)
        reduced[rank[found[pick]], at[owner[pick]]] = name[pick]
        deeper = suffix_arrays(reduced, m[hard], int(names[hard].max())).T.reshape(-1)
        deeper = deeper[deeper >= 0]
        own = hard[deeper % len(hard)]
        order[np.flatnonzero(pick)] = place[first[own] + deeper // len(hard)]
    out = induce(order).reshape(n, lanes)
    return np.where(inside, out, -1)


def repeated(text: np.ndarray, size: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For every suffix, (positions, lanes), whether its first `length` symbols also begin another suffix of its lane.

    By permuted common prefixes: with p the suffix before i in suffix order, the common prefix of i and p is one
    shorter than that of i - 1 and its own predecessor wherever the symbols before i and p agree; only where they differ is
    it found by comparing.
    """
    n, lanes = text.shape
    flat = np.ascontiguousarray(text).reshape(-1)
    total = n * lanes
    before = np.full(total, -1, np.int64)
    have = sa[1:] >= 0
    before[sa[1:][have]] = sa[:-1][have]
    i = np.flatnonzero(before >= 0)
    p = before[i]
    start = (i < lanes) | (p < lanes)
    inner = ~start
    start[inner] = flat[i[inner] - lanes] != flat[p[inner] - lanes]
    i, p = i[start], p[start]
    shared = np.zeros(total, np.int32)
    live, t = np.arange(len(i)), 0
    # A string's last symbol occurs nowhere else in it, so a comparison ends inside the string.
    while len(live):
        ok = flat[i[live] + t * lanes] == flat[p[live] + t * lanes]
        live = live[ok]
        t += 1
        shared[i[live]] = t
    known = np.zeros(total, bool)
    known[i] = True
    known[before < 0] = True
    row = np.arange(n, dtype=np.int32)[:, None]
    source = np.maximum.accumulate(np.where(known.reshape(n, lanes), row, -1), axis=0)
    prefix = np.take_along_axis(shared.reshape(n, lanes), np.maximum(source, 0), axis=0) - (row - source)
    again = (prefix >= length).reshape(-1)
    again[before[np.flatnonzero(again)]] = True
    return again.reshape(n, lanes)
