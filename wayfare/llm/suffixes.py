"""Suffix arrays by induced sorting (Nong, Zhang and Chan 2009), with array operations in place of the scans.

An induction pass reads the suffix array in blocks.  A block is good up to the first place that it writes to
itself; so a block spans as much as is final already, and the number of blocks is about the alphabet's size times
the longest run of one symbol, whatever the length of the text.

The reduced text of names has an alphabet nearly as large as itself, so blocks there are a few places long.  It is
therefore ordered by doubling prefixes (Larsson and Sadakane 2007), where a round is one sort of what is not unique yet.
"""

from __future__ import annotations

import numpy as np

from wayfare.llm.text import U64, _powers, mix


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S), False for larger ones (L); the last is S."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        change = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
        nearest = np.minimum.accumulate(change[::-1])[::-1]
        inside = nearest < n - 1
        at = nearest[inside]
        s[:-1][inside] = t[at] < t[at + 1]
        s[:-1][~inside & (nearest == n)] = True
    return s


def _ranks(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted values: rank within equal ones, the first place of each value, and how many there are."""
    cut = (c[1:] != c[:-1]).nonzero()[0]
    first = np.zeros(len(cut) + 1, np.int64)
    np.add(cut, 1, out=first[1:])
    count = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=count[:-1])
    count[-1] = len(c) - first[-1]
    return np.arange(len(c)) - first.repeat(count), first, count


def _induce(t: np.ndarray, s: np.ndarray, edges: np.ndarray, sa: np.ndarray) -> None:
    """Sort L suffixes from the left, then S suffixes from the right; ``edges``: where the bucket of each symbol begins.

    Empty places of ``sa`` are 0, which has no suffix before it; the one before it wraps to the last suffix, and neither
    pass may take that.
    """
    n, i, block = len(t), 0, 4096
    head, larger = edges[:-1].copy(), ~s
    while i < n:
        e = min(i + block, n)
        j = sa[i:e] - 1
        at = larger[j].nonzero()[0]
        whole = True
        if len(at):
            j = j[at]
            order = t[j].argsort(kind="stable")
            j = j[order]
            c = t[j]
            rank, first, count = _ranks(c)
            to = head[c] + rank
            low = int(to.min())
            if low < e:
                whole, e = False, low
                good = (at[order] < low - i).nonzero()[0]
                j, to, c = j[good], to[good], c[good]
                if len(c):
                    _, first, count = _ranks(c)
            if len(c):
                sa[to] = j
                head[c[first]] += count
        block = min(block * 2, 1 << 18) if whole else max(64, 2 * (e - i))
        i = e
    sa[1:][s[sa[1:]]] = 0  # the seeds: they are placed anew
    tail, e, block = edges[1:] - 1, n, 4096
    smaller = s.copy()
    smaller[-1] = False
    while e > 0:
        i = max(e - block, 0)
        j = sa[i:e][::-1] - 1
        at = smaller[j].nonzero()[0]
        whole = True
        if len(at):
            j = j[at]
            order = t[j].argsort(kind="stable")
            j = j[order]
            c = t[j]
            rank, first, count = _ranks(c)
            to = tail[c] - rank
            high = int(to.max())
            if high >= i:
                whole, i = False, high + 1
                good = (at[order] < e - i).nonzero()[0]
                j, to, c = j[good], to[good], c[good]
                if len(c):
                    _, first, count = _ranks(c)
            if len(c):
                sa[to] = j
                tail[c[first]] -= count
        block = min(block * 2, 1 << 18) if whole else max(64, 2 * (e - i))
        e = i


def doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``names``, whose last one is the least and occurs there only."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    place = np.arange(n)
    rank = np.empty(n, np.int64)  # the first place of all suffixes that are alike so far
    new = np.ones(n, bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    known = 1
    while True:
        # places of suffixes that are not alone; what they share does not reach the last name
        alone = new & np.append(new[1:], True)
        place = place[~alone]
        if not len(place):
            return order
        own = order[place]
        key = rank[own] * n + rank[own + known]
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[place] = own
        new = np.ones(len(own), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, place, 0))
        known *= 2


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """The order of the suffixes of ``t``, whose last symbol is 0 and occurs there only."""
    n = len(t)
    t = t.astype(np.uint16 if symbols <= 1 << 16 else np.int32)
    if n == 1:
        return np.zeros(1, np.int64)
    s = _types(t)
    edges = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1

    def induced(order: np.ndarray) -> np.ndarray:
        sa = np.zeros(n, np.int32 if n < 2**31 else np.int64)
        # seeds at the ends of their buckets, in the given order
        by = np.argsort(t[order], kind="stable")
        seeds = order[by]
        c = t[seeds]
        rank, first, count = _ranks(c)
        sa[edges[c.astype(np.int64) + 1] - np.repeat(count, count) + rank] = seeds
        _induce(t, s, edges, sa)
        return sa

    sa = induced(lms)
    # names of the LMS substrings, in the order found
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = sa[is_lms[sa]]
    end = np.full(n, n - 1)
    end[lms[:-1]] = lms[1:]
    p, inverse = _powers(n + 1)
    total = np.concatenate([[U64(0)], np.cumsum(mix(t.astype(np.uint64) + U64(1)) * p[:n], dtype=np.uint64)])
    size = (end[found] + 1 - found).astype(np.uint64)
    print_ = mix((total[end[found] + 1] - total[found]) * inverse[found] + size)
    name = np.concatenate([[0], np.cumsum(print_[1:] != print_[:-1])])
    if name[-1] + 1 < len(found):
        names = np.empty(n, np.int64)
        names[found] = name
        found = lms[doubled(names[lms])]
    return induced(found)


def shared_prefix(text: np.ndarray, sa: np.ndarray, most: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for each suffix in text order, what it shares with the suffix before it in order, up to ``most``.

    ``text`` is followed by at least ``most`` + 8 bytes of padding.  Eight bytes are compared at a time, and only
    suffixes that have shared all so far go on.  With ``wanted`` (by text position), others are left at 0.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    words = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,))
    out, left = np.zeros(n, np.int64), np.flatnonzero((phi >= 0) if wanted is None else (phi >= 0) & wanted)
    for k in range(0, most, 8):
        x = words[left + k] ^ words[phi[left] + k]
        low = x & (~x + U64(1))  # the lowest bit in which they differ is in the first byte that does
        out[left] = k + np.where(x == 0, 8, np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.int64) // 8)
        left = left[x == 0]
    return np.minimum(out, most)
