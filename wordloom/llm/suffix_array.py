"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy."""

from __future__ import annotations

import numpy as np

FEW = 600
"""Alphabets up to this size are induced a bucket at a time; larger ones, an entry at a time."""


def _s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last, alone, is smallest."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    ascends = t[differs] < t[differs + 1]
    at = np.searchsorted(differs, np.arange(n - 1))
    out = np.ones(n, bool)
    inside = at < len(differs)
    out[:-1][inside] = ascends[at[inside]]
    return out


def _dealt(queues: list[list[np.ndarray]], positions: np.ndarray, symbols: np.ndarray) -> None:
    """Append the positions to the queues of their symbols, in order."""
    if len(positions) == 0:
        return
    order = np.argsort(symbols, kind="stable")
    symbols, positions = symbols[order], positions[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for c, part in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
        queues[c].append(part)


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


def _induce_buckets(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order (or, for LMS substrings, in any)."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _dealt(seeds, lms, t[lms])
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    done_l = []
    for c in range(sigma):
        parts, wave = [], np.concatenate([_none(), *larger[c]])
        while len(wave):
            parts.append(wave)
            p = wave[wave > 0] - 1
            p = p[~s[p]]
            symbols = t[p]
            same = symbols == c
            _dealt(larger, p[~same], symbols[~same])
            wave = p[same]
        own = np.concatenate([_none(), *seeds[c]])
        p = own[own > 0] - 1
        p = p[~s[p]]
        _dealt(larger, p, t[p])
        done_l.append(np.concatenate([_none(), *parts]))
    smaller: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        parts, wave = [], np.concatenate([_none(), *smaller[c]])
        while len(wave):
            parts.append(wave)
            p = wave[wave > 0] - 1
            p = p[s[p]]
            symbols = t[p]
            same = symbols == c
            _dealt(smaller, p[~same], symbols[~same])
            wave = p[same]
        own = done_l[c][::-1]
        p = own[own > 0] - 1
        p = p[s[p]]
        _dealt(smaller, p, t[p])
        out.append(np.concatenate([_none(), *parts]))
        out.append(own)
    out.append(np.array([len(t) - 1]))  # the end mark, which nothing induces
    return np.concatenate(out)[::-1]


def _induce_entries(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """As above, entry by entry, for large alphabets."""
    n = len(t)
    counts = np.bincount(t, minlength=sigma)
    tails = np.cumsum(counts)
    # The given suffixes go to the ends of their buckets, in order.
    symbols = t[lms]
    by_symbol = np.argsort(symbols, kind="stable")
    held = np.bincount(symbols, minlength=sigma)
    first = (tails - held)[symbols[by_symbol]] + np.arange(len(lms)) - (np.cumsum(held) - held)[symbols[by_symbol]]
    placed = np.full(n, -1, np.int64)
    placed[first] = lms[by_symbol]
    sa = placed.tolist()
    # What each entry, or none (-1), induces: the symbol before it, if that is of the type in question.
    before = np.append(np.where(np.arange(n) > 0, t[np.arange(n) - 1], -1), -1)
    smaller = np.append(s[np.arange(n) - 1], False)
    larger_of, smaller_of = np.where(smaller, -1, before).tolist(), np.where(smaller, before, -1).tolist()
    heads = (tails - counts).tolist()
    for v in sa:  # entries put in further on are met in turn
        c = larger_of[v]
        if c >= 0:
            sa[heads[c]] = v - 1
            heads[c] += 1
    ends = tails.tolist()
    for v in reversed(sa):
        c = smaller_of[v]
        if c >= 0:
            ends[c] -= 1
            sa[ends[c]] = v - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes of ``t`` in order; its last symbol must be 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    induce = _induce_buckets if sigma <= FEW else _induce_entries
    s = _s_types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        # Name the LMS substrings in their order; equal neighbours get one name.
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = induce(t, s, lms, sigma)
        order = order[is_lms[order]]
        length = np.zeros(n, np.int64)
        length[lms] = np.append(np.diff(lms), 0) + 1
        sizes = length[order]
        like = np.flatnonzero(sizes[1:] == sizes[:-1])
        many = sizes[like]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        unequal = t[np.repeat(order[like], many) + within] != t[np.repeat(order[like + 1], many) + within]
        equal = ~np.logical_or.reduceat(unequal, np.cumsum(many) - many) if len(like) else np.zeros(0, bool)
        new = np.ones(len(order), bool)
        new[like[equal] + 1] = False
        name = np.zeros(n, np.int64)
        name[order] = np.cumsum(new) - 1
        names = int(new.sum())
        lms = order if names == len(order) else lms[suffix_array(name[lms], names)]
    return induce(t, s, lms, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): for each start the suffix before it in order, and the prefix they share, up to ``most``.

    Only where the symbols before differ is a prefix compared; everywhere else
    it is one shorter than that of the start before.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    before = np.concatenate([[-1], t])  # before[i] is the symbol left of i
    apart = (phi < 0) | (before[np.arange(n)] != before[np.maximum(phi, 0)]) | (phi == 0)
    apart[0] = True
    starts = np.flatnonzero(apart)
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.full(8, -1, t.dtype)])
    live = starts[phi[starts] >= 0]
    shared = np.zeros(n, np.int64)
    while len(live):
        a, b = live + shared[live], phi[live] + shared[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        run = np.zeros(len(live), np.int64)
        same = np.ones(len(live), bool)
        for k in range(8):
            same &= padded[np.minimum(a + k, n)] == padded[np.minimum(b + k, n)]
            same &= np.maximum(a, b) + k < n
            run += same
        shared[live] += run
        live = live[(run == 8) & (shared[live] < n)]
    # A start that is not apart has one less than the start before it.
    last = np.maximum.accumulate(np.where(apart, np.arange(n), 0))
    plcp = np.maximum(shared[last] - (np.arange(n) - last), 0)
    return np.minimum(plcp, most), phi
