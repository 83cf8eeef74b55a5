"""Suffix arrays by induced sorting and permuted common prefixes.

The top level, where the alphabet is small, induces a whole wave of suffixes at a time with array operations; the
names of the leftmost-smaller (LMS) substrings form a string a third as long, sorted recursively by the same algorithm,
which for its large alphabet induces by blocks of the array.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour; the sentinel counts as smaller."""
    n = len(s)
    up = np.append(s[1:] > s[:-1], True)
    known = np.where(up | np.append(s[1:] < s[:-1], True), np.arange(n, dtype=np.int32), np.int32(n - 1))
    return up[np.minimum.accumulate(known[::-1])[::-1]]


def _narrow(s: np.ndarray, k: int) -> np.ndarray:
    """Symbols below ``k`` in 16 bits if they fit: those are sorted by radix."""
    return s.astype(np.uint16) if k <= 1 << 16 else s


def _changes(c: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    new = np.ones(len(c), bool)
    np.not_equal(c[1:], c[:-1], out=new[1:])
    return np.flatnonzero(new)


def _waves(s: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Induce the order of all suffixes from LMS suffixes given in order; one array operation per wave of a bucket."""
    n, k = len(s), len(heads)
    sa = np.full(n, -1, np.int32)
    at = tails.copy()
    s = _narrow(s, k)
    chars = s[lms]
    order = np.argsort(chars, kind="stable")
    sorted_lms, sorted_chars = lms[order], chars[order]
    counts = np.bincount(sorted_chars, minlength=k)
    first = np.cumsum(counts) - counts
    sa[tails[sorted_chars] - counts[sorted_chars] + np.arange(len(lms)) - first[sorted_chars]] = sorted_lms
    head = heads.copy()
    lo_s = tails - counts  # where a bucket's LMS suffixes begin

    def place(prev: np.ndarray) -> None:
        c = s[prev]
        by = np.argsort(c, kind="stable")
        prev, c = prev[by], c[by]
        cut = _changes(c)
        size = np.append(cut[1:], len(c)) - cut
        sa[head[c] + np.arange(len(c)) - np.repeat(cut, size)] = prev
        head[c[cut]] += size

    for c in range(k):
        done = heads[c]
        while done < head[c]:  # larger-type suffixes of this bucket, as long as it induces its own
            part, done = sa[done : head[c]], head[c]
            prev = part[part > 0] - 1
            prev = prev[~small[prev]]
            if len(prev):
                place(prev)
        part = sa[lo_s[c] : tails[c]]
        prev = part[part > 0] - 1
        prev = prev[~small[prev]]
        if len(prev):
            place(prev)
    tail = at
    keep_first = sa[0]

    def place_back(prev: np.ndarray) -> None:
        c = s[prev]
        by = np.argsort(c, kind="stable")
        prev, c = prev[by], c[by]
        cut = _changes(c)
        size = np.append(cut[1:], len(c)) - cut
        sa[tail[c] - 1 - (np.arange(len(c)) - np.repeat(cut, size))] = prev
        tail[c[cut]] -= size

    for c in range(k - 1, -1, -1):
        done = tails[c]
        while tail[c] < done:
            part, done = sa[tail[c] : done][::-1], tail[c]
            prev = part[part > 0] - 1
            prev = prev[small[prev]]
            if len(prev):
                place_back(prev)
        part = sa[heads[c] : head[c]][::-1]
        prev = part[part > 0] - 1
        prev = prev[small[prev]]
        if len(prev):
            place_back(prev)
    sa[0] = keep_first
    return sa


def _blocks(s: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same induction for large alphabets, a block of the array at a time.

    What a block induces goes behind it, mostly far behind. A block ends before the first place that it fills itself,
    so all its entries are known and induce together, in their order.
    """
    n = len(s)
    sa = np.full(n, -1, np.int32)
    s = _narrow(s, len(heads))
    order = lms[np.argsort(s[lms], kind="stable")]
    chars = s[order]
    counts = np.bincount(chars, minlength=len(heads))
    sa[tails[chars] - counts[chars] + np.arange(len(lms)) - (np.cumsum(counts) - counts)[chars]] = order
    _sweep(sa, s, ~small, heads.copy())
    last = sa[0]
    # mirrored, the smaller-type suffixes are induced in the same way: places and buckets counted from the end
    sa[1:][small[sa[1:]] & (sa[1:] >= 0)] = -1
    sa[0] = -1
    back = sa[::-1]
    _sweep(back, s, small, n - tails)
    sa[0] = last
    return sa


def _sweep(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> None:
    """Put each ``wanted`` predecessor of an entry, in the entries' order, at its bucket's next place ``at``."""
    n, i, size = len(s), 0, 256
    while i < n:
        hi = min(n, i + size)
        place = np.flatnonzero(sa[i:hi] > 0)
        prev = sa[i:hi][place] - 1
        good = wanted[prev]
        prev, place = prev[good], place[good] + i
        if not len(prev):
            i, size = hi, size * 2
            continue
        c = s[prev]
        by = np.argsort(c, kind="stable")
        c, prev, place = c[by], prev[by], place[by]
        begin = _changes(c)
        rank = np.arange(len(c)) - np.repeat(begin, np.append(begin[1:], len(c)) - begin)
        to = at[c] + rank
        end = min(hi, int(to.min()))
        if end < hi:
            known = place < end
            c, prev, to = c[known], prev[known], to[known]
        sa[to] = prev
        np.maximum.at(at, c, to + 1)
        size = max(64, 2 * (end - i)) if end < hi else size * 2
        if end - i < 16:  # a run of one symbol fills its own next places
            end = _one_by_one(sa, s, wanted, at, end, min(n, end + 256))
        i = end


def _one_by_one(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, at: np.ndarray, i: int, end: int) -> int:
    for k in range(i, end):
        p = int(sa[k]) - 1
        if p >= 0 and wanted[p]:
            c = s[p]
            sa[at[c]] = p
            at[c] += 1
    return end


def suffix_array(s: np.ndarray, waves: bool | None = None) -> np.ndarray:
    """Suffix array of fewer than 2^31 non-negative integers that end in a unique 0, the smallest."""
    s = np.asarray(s, np.int32)
    n = len(s)
    if n <= 2:
        return np.arange(n, dtype=np.int32)[::-1]
    k = int(s.max()) + 1
    counts = np.bincount(s, minlength=k)
    tails = np.cumsum(counts)
    heads = tails - counts
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    waves = k * 64 <= n if waves is None else waves

    def induce(order: np.ndarray) -> np.ndarray:
        if waves:
            return _waves(s, small, heads, tails, order)
        return _blocks(s, small, heads, tails, order)

    if len(lms) > 1:
        sa = induce(lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        length = np.zeros(n, np.int32)  # of an LMS substring, with the next one's first symbol
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        alive = np.flatnonzero(length[a] == length[b])
        equal = np.zeros(len(a), bool)
        depth = 0
        while len(alive):
            ended = length[a[alive]] <= depth
            equal[alive[ended]] = True
            alive = alive[~ended]
            alive = alive[s[a[alive] + depth] == s[b[alive] + depth]]
            depth += 1
        same[1:] = equal
        names = np.cumsum(~same) - 1
        if names[-1] + 1 < len(lms):
            slot = np.zeros(n, np.int32)
            slot[order] = names
            order = lms[suffix_array(slot[lms])]
        return induce(order)
    return induce(lms)


def common_prefixes(s: np.ndarray, sa: np.ndarray, stop: int = -1) -> np.ndarray:
    """For each position, its common prefix with the suffix before it in ``sa``; symbols up to ``stop`` end a prefix.

    Permuted order: a prefix is one shorter than its left neighbour's unless the two preceding symbols differ, so
    only those positions are compared, all at once, and the rest follow by subtraction.
    """
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] <= 0) | (phi[:-1] + 1 != phi[1:]) | (s[:-1] != s[np.maximum(phi[1:], 1) - 1]) | (s[:-1] <= stop)
    own = np.flatnonzero(fresh)
    plcp = np.zeros(n, np.int32)
    alive = own[phi[own] >= 0]
    depth = 0
    while len(alive):
        x, y = alive + depth, phi[alive] + depth
        inside = (x < n) & (y < n)
        alive, x, y = alive[inside], x[inside], y[inside]
        alive = alive[(s[x] == s[y]) & (s[x] > stop)]
        depth += 1
        plcp[alive] = depth
    lead = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.maximum(plcp[lead] - (at - lead), 0)
