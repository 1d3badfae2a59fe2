"""Suffix arrays by induced sorting and permuted common prefixes, over numpy arrays.

`suffix_array` follows the induced-sorting scheme of Nong, Zhang and Chan: suffixes are classified by whether they are
smaller than the one after them, the leftmost such substrings (LMS) are sorted and named, their suffixes are sorted by name, and one
pass to the right and one to the left induce the order of all others. A pass handles a bucket (all suffixes of one
first byte) at once: what a bucket induces is dealt to later buckets by a stable sort, and what it induces in itself is a
next wave. The string of names is sorted by doubling ranks, which stays vectorised for its large alphabet.

`common_prefixes` computes the permuted LCP array: only at irreducible positions are texts compared, the others follow.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (the empty suffix is the smallest of all)."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    if n < 2:
        return s
    differs = np.flatnonzero(t[:-1] != t[1:])
    rises = t[differs] < t[differs + 1]
    after = np.searchsorted(differs, np.arange(n - 1))  # the next place where the byte changes decides
    inside = after < len(differs)
    s[:-1][inside] = rises[after[inside]]
    return s


def _dealt(pending: list[list[np.ndarray]], chars: np.ndarray, entries: np.ndarray) -> None:
    """Appends entries to their buckets, in order."""
    if not len(entries):
        return
    turn = np.argsort(chars, kind="stable")
    chars, entries = chars[turn], entries[turn]
    edges = np.flatnonzero(np.diff(chars)) + 1
    for c, part in zip(chars[np.r_[0, edges]].tolist(), np.split(entries, edges)):
        pending[c].append(part)


def _induced(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of LMS suffixes induces."""
    n, size = len(t), int(t.max()) + 1
    own: list[list[np.ndarray]] = [[] for _ in range(size)]
    _dealt(own, t[lms], lms)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]  # L-type suffixes by bucket, ascending
    larger[t[n - 1]].append(np.array([n - 1], dtype=lms.dtype))  # the last suffix, induced by the empty one
    done_l: list[np.ndarray] = []
    empty = np.zeros(0, dtype=lms.dtype)
    for c in range(size):
        waves = []
        wave = np.concatenate(larger[c]) if larger[c] else empty
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            before = before[~s[before]]
            chars = t[before]
            same = chars == c
            _dealt(larger, chars[~same], before[~same])
            wave = before[same]
        done_l.append(np.concatenate(waves) if waves else empty)
        if own[c]:
            first = np.concatenate(own[c])
            before = first[first > 0] - 1
            before = before[~s[before]]
            _dealt(larger, t[before], before)
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]  # S-type suffixes by bucket, descending
    out = []
    for c in range(size - 1, -1, -1):
        waves = []
        wave = np.concatenate(smaller[c]) if smaller[c] else empty
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            before = before[s[before]]
            chars = t[before]
            same = chars == c
            _dealt(smaller, chars[~same], before[~same])
            wave = before[same]
        last = done_l[c][::-1]
        before = last[last > 0] - 1
        before = before[s[before]]
        _dealt(smaller, t[before], before)
        out += waves
        out.append(last)
    return np.concatenate(out)[::-1]


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings (at their place in `lms`), equal for equal substrings, in their order."""
    place = np.zeros(len(t), dtype=np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.append(np.diff(lms), len(t) - lms[-1]).astype(np.int64)
    k = place[ordered]
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    same = length[k[:-1]] == length[k[1:]]
    same &= (k[:-1] != len(lms) - 1) & (k[1:] != len(lms) - 1)  # the last runs into the end of the text
    live = np.flatnonzero(same)
    size = length[k[:-1]][live] + 1
    at = 0
    while len(live):
        equal = t[a[live] + at] == t[b[live] + at]
        same[live[~equal]] = False
        at += 1
        on = equal & (at < size)
        live, size = live[on], size[on]
    names = np.zeros(len(lms), dtype=np.int64)
    names[k] = np.r_[0, np.cumsum(~same)] + 1
    return names


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names from 1."""
    rank, step = names, 1
    n = len(names)
    while True:
        if int(rank.max()) == n:
            return np.argsort(rank)
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - step] = rank[step:]
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)] + 1
        rank, step = new, step * 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array, smallest first."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    s = classify(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    if not len(lms):
        return _induced(t, s, lms)
    rough = _induced(t, s, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    names = _names(t, lms, rough[is_lms[rough]])
    return _induced(t, s, lms[_by_doubling(names)])


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the start of the suffix before it in order (-1 for the first), and the length both share."""
    n = len(t)
    prior = np.full(n, -1, dtype=np.int64)
    prior[sa[1:]] = sa[:-1]
    at = np.arange(n)
    real = prior >= 0
    irreducible = ~real | (at == 0) | (prior == 0)
    rest = np.flatnonzero(~irreducible)
    irreducible[rest] = t[rest - 1] != t[prior[rest] - 1]
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = t
    eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    shared = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(irreducible & real)
    a, b = live.copy(), prior[live]
    while len(live):
        x = eight[a] ^ eight[b]
        part = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        part = np.minimum(part, n - np.maximum(a, b))
        shared[live] += part
        on = (x == 0) & (np.maximum(a, b) + 8 < n)
        live, a, b = live[on], a[on] + 8, b[on] + 8
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return prior, shared[last] - (at - last)
