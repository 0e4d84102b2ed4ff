"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as smaller or larger than their successor. Leftmost-smaller (LMS) substrings are sorted by one
induction and named; if names repeat, the string of names is sorted by recursion, at every size; a last induction from
the sorted LMS suffixes gives the array. Every level is linear in its string, which is at most half as long as the one
above.

Induction runs bucket by bucket in whole-array steps where buckets are well filled: inside a bucket it proceeds in
waves, a wave being what the last one put into the same bucket, so its predecessors are placed with one stable sort.
Strings of names have about as many buckets as suffixes; there the same scans run suffix by suffix.
"""

from __future__ import annotations

import numpy as np

FILLED = 32  # suffixes of a bucket, on average, from which whole-array steps are faster than a loop


def _place(sa: np.ndarray, found: np.ndarray, chars: np.ndarray, edge: np.ndarray, sign: int) -> None:
    """Append suffixes to their buckets at ``edge``, which moves by ``sign``, keeping their order."""
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    begin = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    count = np.diff(np.r_[begin, len(chars)])
    sa[edge[chars] + sign * (np.arange(len(chars)) - np.repeat(begin, count))] = found[order]
    edge[chars[begin]] += sign * count


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of LMS suffixes induces."""
    n, sa = len(s), np.full(len(s), -1, np.int64)
    heads, present = np.r_[0, ends[:-1]], np.flatnonzero(np.diff(np.r_[0, ends]))
    begin = heads.copy()
    seeds = lms[np.argsort(s[lms], kind="stable")]
    cut = np.searchsorted(s[seeds], np.arange(len(ends) + 1))

    def push(batch: np.ndarray, edge: np.ndarray, kind: bool, sign: int) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before] == kind]
        if len(before):
            _place(sa, before, s[before], edge, sign)

    for c in present:
        low = begin[c]
        while low < heads[c]:
            low, batch = heads[c], sa[low : heads[c]]
            push(batch, heads, False, 1)
        if cut[c + 1] > cut[c]:
            push(seeds[cut[c] : cut[c + 1]], heads, False, 1)
    tails = ends - 1
    if n:
        sa[0] = n - 1
    for c in present[::-1]:
        high = ends[c] - 1
        while high > tails[c]:
            high, batch = tails[c], sa[tails[c] + 1 : high + 1][::-1]
            push(batch, tails, True, -1)
        push(sa[begin[c] : heads[c]][::-1], tails, True, -1)
    return sa


def _induce_listed(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``_induce`` for strings whose buckets hold few suffixes: the same two scans, suffix by suffix."""
    n = len(s)
    text, kind, sa = s.tolist(), small.tolist(), [-1] * n
    tails = ends.tolist()
    for i in lms[np.argsort(s[lms], kind="stable")][::-1].tolist():  # seeds wait at the ends of their buckets
        tails[text[i]] -= 1
        sa[tails[text[i]]] = i
    heads = [0, *ends[:-1].tolist()]
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            sa[heads[c]] = j
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and kind[j]:
            c = tails[text[j]] = tails[text[j]] - 1
            sa[c] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _sais(s: np.ndarray, alphabet: int) -> np.ndarray:
    """s ends in its only 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    step = np.sign(np.diff(s))
    change = np.where(step != 0, np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    small = np.r_[step[np.minimum(change, n - 2)] > 0, True]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=alphabet))
    induce = _induce if n >= FILLED * alphabet else _induce_listed
    if len(lms) > 1:
        sa = induce(s, small, lms, ends)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        length = np.ones(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        size = length[order]
        same = size[1:] == size[:-1]
        pair = np.flatnonzero(same)
        if len(pair):
            count = size[pair + 1]
            start = np.cumsum(count) - count
            inside = np.arange(count.sum()) - np.repeat(start, count)
            differ = s[np.repeat(order[pair], count) + inside] != s[np.repeat(order[pair + 1], count) + inside]
            same[pair] = np.add.reduceat(differ.astype(np.int64), start) == 0
        name = np.cumsum(np.r_[0, ~same])
        if name[-1] + 1 < len(lms):
            named = np.zeros(n, np.int64)
            named[order] = name
            reduced = named[lms]
            order = lms[_sais(reduced, int(name[-1]) + 1)]
        lms = order
    return induce(s, small, lms, ends)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The places of all suffixes of some bytes or 16-bit symbols, in ascending order."""
    if not len(data):
        return np.zeros(0, np.int64)
    return _sais(np.r_[data.astype(np.int64) + 1, 0], int(data.max()) + 2)[1:]


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place the length of the prefix shared with the suffix that sorts just before.

    Only irreducible places are compared, four symbols at a time: where the symbols before the two suffixes are equal,
    the value is the one of the place before less one.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    reducible = (place > 0) & (before > 0)
    reducible[reducible] = data[place[reducible] - 1] == data[before[reducible] - 1]
    padded = np.r_[data, np.zeros(8, data.dtype)]
    four = np.zeros(n + 4, np.uint64)
    for k in range(4):
        four |= padded[k : k + n + 4].astype(np.uint64) << np.uint64(16 * k)
    first = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    active = first[before[first] >= 0]
    shared = np.zeros(len(active), np.int64)
    live = np.arange(len(active))
    a, b = active, before[active]
    while len(live):
        x, y = a[live] + shared[live], b[live] + shared[live]
        inside = np.maximum(x, y) < n
        equal = inside & (four[np.minimum(x, n)] == four[np.minimum(y, n)])
        ending = live[~equal]
        for _ in range(4):
            x, y = a[ending] + shared[ending], b[ending] + shared[ending]
            ok = (np.maximum(x, y) < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
            ending = ending[ok]
            shared[ending] += 1
        live = live[equal]
        shared[live] += 4
    shared = np.minimum(shared, n - np.maximum(a, b))
    value[active] = shared
    last = np.maximum.accumulate(np.where(~reducible, place, 0))
    return value[last] - (place - last)
