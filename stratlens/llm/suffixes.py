"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as S (smaller than the next) or L, the leftmost S ones (LMS) are sorted as
substrings by one induction, named by comparing neighbours, sorted recursively where names repeat, and
induce the final order.  Every level, of any length, is induced linearly: each suffix is moved once in
each of two scans.  Byte texts advance in waves of whole arrays (inside a bucket one for every repeat
of its symbol); names have large alphabets and small buckets, for which one suffix after the other is moved.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S-type positions; the last one is L, as the end counts as the smallest symbol."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        up = t[:-1] < t[1:]
        tie = t[:-1] == t[1:]
        decided = np.where(tie, n - 1, np.arange(n - 1))
        nearest = np.minimum.accumulate(decided[::-1])[::-1]
        s[:-1] = np.where(nearest < n - 1, up[np.minimum(nearest, n - 2)], False)
    return s


def _push(sa, ptr, t, j, k, step):
    """Append positions j, in order, to the buckets of their symbols, from the head or (step -1) the tail."""
    sym = t[j]
    order = np.argsort(sym, kind="stable")
    sym, j = sym[order], j[order]
    count = np.bincount(sym, minlength=k)
    first = np.cumsum(count) - count
    rank = np.arange(len(j)) - first[sym]
    sa[ptr[sym] + step * rank] = j
    ptr += step * count


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array induced from LMS suffixes given in their order."""
    n = len(t)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int64)
    head = begin.copy()
    by = np.argsort(t[lms], kind="stable")
    seeds = lms[by]
    seed_at = np.searchsorted(t[seeds], np.arange(k + 1))
    _push(sa, head, t, np.array([n - 1]), k, 1)
    for c in np.flatnonzero(size):
        done = begin[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            j = wave - 1
            j = j[j >= 0]
            j = j[~s[j]]
            if len(j):
                _push(sa, head, t, j, k, 1)
        if seed_at[c] < seed_at[c + 1]:
            _push(sa, head, t, seeds[seed_at[c] : seed_at[c + 1]] - 1, k, 1)
    tail = end - 1
    for c in np.flatnonzero(size)[::-1]:
        done = end[c] - 1
        while done > tail[c]:
            wave = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            j = wave - 1
            j = j[j >= 0]
            j = j[s[j]]
            if len(j):
                _push(sa, tail, t, j, k, -1)
        j = sa[begin[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        j = j[s[j]]
        if len(j):
            _push(sa, tail, t, j, k, -1)
    return sa


def _induce_names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """As ``_induce``, one suffix after the other: for large alphabets and short texts."""
    n = len(t)
    end = np.cumsum(np.bincount(t, minlength=k))
    head, tail = np.append(0, end[:-1]).tolist(), (end - 1).tolist()
    sym, sa = t.tolist(), [0] * n
    # the symbol before each suffix, if that one is to be moved; nothing precedes the first suffix, 0, so it moves none
    large, small = (np.append(-1, np.where(x, t[:-1].astype(np.int64), -1)).tolist() for x in (~s[:-1], s[:-1]))
    last = tail.copy()
    for i in lms[::-1].tolist():
        c = sym[i]
        sa[last[c]] = i
        last[c] -= 1
    c = sym[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for i in sa:  # which the loop fills as it goes
        c = large[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    for i in reversed(sa):
        c = small[i]
        if c >= 0:
            sa[tail[c]] = i - 1
            tail[c] -= 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Start positions in the order of their suffixes."""
    t = np.asarray(t).astype(np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    k = int(t.max()) + 1 if k is None else k
    if k <= 65536:
        t = t.astype(np.uint16)  # a narrow type sorts by radix
    induce = _induce if k <= 1024 and n > 4096 else _induce_names
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):
        return induce(t, s, lms, k)
    order = induce(t, s, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # name LMS substrings: neighbours of equal content share a name
    where = np.empty(n, np.int64)
    where[lms] = np.arange(len(lms))
    rank = where[order]
    new = np.append(True, ~_equal_neighbours(t, order, np.append(lms[1:], n)[rank] - order + 1))
    name = np.cumsum(new) - 1
    reduced = np.empty(len(lms), np.int64)
    reduced[rank] = name
    if name[-1] + 1 < len(lms):
        order = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return induce(t, s, order, k)


def _equal_neighbours(t: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each substring (start, size) equals the one before it; one that reaches past the end equals none."""
    left, right, n = start[:-1], start[1:], len(t)
    inside = start + size <= n
    out = (size[:-1] == size[1:]) & inside[:-1] & inside[1:]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(8, t.dtype)]), 8)
    todo, at = np.flatnonzero(out), 0
    while len(todo):
        differ = (words[left[todo] + at] != words[right[todo] + at]) & (np.arange(at, at + 8) < size[1:][todo, None])
        bad = differ.any(axis=1)
        out[todo[bad]] = False
        at += 8
        todo = todo[~bad & (size[1:][todo] > at)]
    return out


def permuted_lcp(data: np.ndarray, sa: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each position, the prefix it shares with its predecessor in the suffix array.

    ``stop`` is the end of the text that a position belongs to; prefixes end there.  Only irreducible
    positions, whose left neighbours differ, are compared; the others follow from the one before.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = i[1:][(phi[1:] > 0)]
    before = phi[inner] - 1
    same = (data[inner - 1] == data[before]) & (phi[inner - 1] == before) & (stop[inner - 1] == stop[inner]) & (stop[before] == stop[before + 1])
    reducible[inner[same]] = True
    todo = np.flatnonzero(~reducible & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    most = np.minimum(stop[todo] - todo, stop[phi[todo]] - phi[todo])
    padded = np.concatenate([data, np.zeros(8, data.dtype)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(todo):
        at = plcp[todo]
        differ = words[todo + at] != words[phi[todo] + at]
        step = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        plcp[todo] = np.minimum(at + step, most)
        more = (step == 8) & (at + 8 < most)
        todo, most = todo[more], most[more]
    anchor = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.where(reducible, np.maximum(plcp[anchor] - (i - anchor), 0), plcp)
