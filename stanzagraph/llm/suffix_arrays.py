"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Strings of so many letters are sorted as they are.
FEW = 64


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type). s ends in a unique 0."""
    n = len(s)
    rising = np.empty(n, bool)
    rising[:-1] = s[:-1] < s[1:]
    rising[-1] = True
    decided = np.empty(n, bool)
    decided[:-1] = s[:-1] != s[1:]
    decided[-1] = True
    at = np.where(decided, np.arange(n), n - 1)
    return rising[np.minimum.accumulate(at[::-1])[::-1]]


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller suffixes ``seeds`` in order.

    One sweep upwards puts the larger-type suffixes, one downwards the smaller-type ones.
    A sweep takes as many buckets at once as put nothing into each other, so its steps
    follow the root of the length rather than the number of letters; a bucket that puts
    suffixes into itself goes alone, in as many waves as its longest run of one letter.
    """
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=k))
    starts = np.r_[0, ends[:-1]]
    sa = np.full(n, -1, np.int32)

    count = np.arange(n)

    def found(wave: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes one to the left of the wave's, if of this kind, and their first letters."""
        q = wave[wave > 0] - 1
        q = q[small[q] == kind]
        return q, s[q]

    def put(q: np.ndarray, letters: np.ndarray, heads: np.ndarray, step: int) -> None:
        """Suffixes in the sweep's order to the heads of their buckets."""
        m = len(q)
        if m < 2:
            if m:
                sa[heads[letters[0]]] = q[0]
                heads[letters[0]] += step
            return
        order = letters.argsort(kind="stable")
        q, letters = q[order], letters[order]
        new = np.empty(m, bool)
        new[0] = True
        np.not_equal(letters[1:], letters[:-1], out=new[1:])
        first = new.nonzero()[0]
        many = np.empty(len(first), np.int64)
        many[-1] = m - first[-1]
        np.subtract(first[1:], first[:-1], out=many[:-1])
        sa[heads[letters] + step * (count[:m] - first.repeat(many))] = q
        heads[letters[first]] += step * many

    letters = s[seeds]
    places = ends[letters] - (np.cumsum(np.bincount(letters, minlength=k))[letters] - count[: len(seeds)])
    sa[places] = seeds
    heads, c, wide = starts.copy(), 0, 1
    while c < k:
        upto = min(k, c + wide)
        q, letters = found(sa[starts[c] : ends[upto - 1]], False)
        inside = letters[letters < upto]
        met = int(inside.min()) if len(inside) else upto
        if met > c:
            if met < upto:
                own = s[q + 1] < met
                q, letters = q[own], letters[own]
            put(q, letters, heads, 1)
            c, wide = met, 2 * wide if met == upto else met - c
            continue
        done = starts[c]
        while done < heads[c]:
            now = heads[c]
            put(*found(sa[done:now], False), heads, 1)
            done = now
        put(*found(sa[heads[c] : ends[c]], False), heads, 1)
        c += 1
    sa[places] = -1  # the second sweep fills them again; but nothing puts the sentinel
    sa[0] = n - 1
    tails, c, wide = ends - 1, k - 1, 1
    while c >= 0:
        down = max(0, c - wide + 1)
        q, letters = found(sa[starts[down] : ends[c]][::-1], True)
        inside = letters[letters >= down]
        met = int(inside.max()) if len(inside) else down - 1
        if met < c:
            if met >= down:
                own = s[q + 1] > met
                q, letters = q[own], letters[own]
            put(q, letters, tails, -1)
            c, wide = met, 2 * wide if met < down else c - met
            continue
        done = ends[c] - 1
        while done > tails[c]:
            now = tails[c]
            put(*found(sa[now + 1 : done + 1][::-1], True), tails, -1)
            done = now
        put(*found(sa[starts[c] : tails[c] + 1][::-1], True), tails, -1)
        c -= 1
    return sa


def sorted_substrings(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost-smaller substrings in order, and where a new one starts among them.

    A substring goes from one leftmost-smaller place to the next. Letters count with their
    types, of which the larger is less. As many as a word holds are compared at once, the
    next ones only where substrings were the same so far and go on.
    """
    length = np.ones(len(lms), np.int64)
    length[:-1] = np.diff(lms) + 1
    value = np.zeros(len(s) + 64, np.int64)
    value[: len(s)] = 2 * s.astype(np.int64) + small
    bits = int(2 * k + 1).bit_length()
    each = max(1, min(64, 63 // bits))

    def keys(which: np.ndarray, offset: int) -> np.ndarray:
        out, left, at = np.zeros(len(which), np.int64), length[which] - offset, lms[which] + offset
        for j in range(each):
            out <<= bits
            out |= np.where(left > j, value[at + j], 0)
        return out

    key = keys(np.arange(len(lms)), 0)
    order = key.argsort(kind="stable")
    key = key[order]
    new = np.ones(len(lms), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    offset = each
    while True:
        same = ~new
        same[:-1] |= ~new[1:]
        at = np.flatnonzero(same & (length[order] > offset))
        if not len(at):
            return order, new
        group = np.cumsum(new)[at]
        key = keys(order[at], offset)
        now = np.lexsort((key, group))
        order[at], key = order[at][now], key[now]
        fresh = new[at]
        fresh[1:] |= key[1:] != key[:-1]
        new[at] = fresh
        offset += each


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of ``s``: letters below ``k``, the last a 0 that occurs nowhere else.

    Leftmost-smaller substrings are sorted and named; where names repeat, the string of
    names is sorted the same way. All other suffixes are induced from them.
    """
    n = len(s)
    if n <= FEW:
        letters = s.tolist()
        return np.asarray(sorted(range(n), key=lambda i: letters[i:]), np.int32)
    small = suffix_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    order, new = sorted_substrings(s, small, lms, k)
    names = np.cumsum(new) - 1
    if names[-1] < len(lms) - 1:
        reduced = np.empty(len(lms), np.int32)
        reduced[order] = names  # ends in the sentinel's name, 0
        order = suffix_array(reduced, int(names[-1]) + 1)
    return induce(s, small, lms[order], k)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, heads: np.ndarray, most: int) -> np.ndarray:
    """For each position, its common prefix with the suffix before it in ``sa``.

    Only positions whose letter to the left differs from its neighbour's are compared; at
    the others the prefix is one shorter than at the position to the left. ``heads`` are
    positions that are compared in any case, and comparisons stop at ``most`` letters, so
    values are exact up to ``most`` less the distance from the last position compared.
    """
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    left = phi[1:] > 0
    own[1:] = ~left | (s[:-1] != s[np.maximum(phi[1:] - 1, 0)])
    own[heads] = True
    at = np.flatnonzero(own)
    alive = np.flatnonzero(phi[at] >= 0)
    prefix = np.zeros(len(at), np.int32)
    padded = np.r_[s, np.full(1, -1, s.dtype)]
    i, j = at[alive], phi[at[alive]]
    for _ in range(most):
        same = (padded[np.minimum(i, n)] == padded[np.minimum(j, n)]) & (i < n) & (j < n)
        alive, i, j = alive[same], i[same] + 1, j[same] + 1
        if not len(alive):
            break
        prefix[alive] += 1
    which = np.cumsum(own) - 1
    return np.maximum(prefix[which] - (np.arange(n) - at[which]), 0)
