"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's bytes.

Bytes are handled a bucket at a time with numpy: a bucket's suffixes are in order when its
turn comes, and those before them go to their buckets by one stable deal.  The reduced
strings of the recursion have large alphabets and are induced suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a suffix is smaller than the next one, leftmost such positions)."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    less = np.append(text[:-1] < text[1:], False)
    # A run of equal symbols is as its last one.
    ends = np.where(differs, np.arange(n), n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    small = less[ends]
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induced_bytes(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost smaller ones induces."""
    n = len(text)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, -1, np.int64)

    def deal(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Puts suffixes into their buckets, in order, from ``at`` on (or backwards)."""
        symbols = text[found]
        order = np.argsort(symbols, kind="stable")
        sorted_ = symbols[order]
        counts = np.bincount(sorted_, minlength=256)
        nth = np.arange(len(found)) - (np.cumsum(counts) - counts)[sorted_]
        out[(at[sorted_] + nth) if step > 0 else (at[sorted_] - 1 - nth)] = found[order]
        at += step * counts

    tails = ends.copy()
    deal(lms[::-1], tails, -1)
    last = tails.copy()  # where the leftmost smaller suffixes of each bucket begin
    heads = starts.copy()
    deal(np.array([n - 1]), heads, 1)
    used = np.flatnonzero(sizes)
    for c in used:
        lo = starts[c]
        while lo < heads[c]:
            hi = heads[c]
            before = out[lo:hi] - 1
            before = before[before >= 0]
            deal(before[~small[before]], heads, 1)
            lo = hi
        if last[c] < ends[c]:
            deal(out[last[c] : ends[c]] - 1, heads, 1)
    tails = ends.copy()
    for c in used[::-1]:
        hi = ends[c]
        while hi > tails[c]:
            lo = tails[c]
            before = out[lo:hi][::-1] - 1
            before = before[before >= 0]
            deal(before[small[before]], tails, -1)
            hi = lo
        before = out[starts[c] : heads[c]][::-1] - 1
        before = before[before >= 0]
        deal(before[small[before]], tails, -1)
    return out


def _induced_names(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """:func:`_induced_bytes` for symbols 0, 1, ... of any number."""
    n, sizes = len(text), np.bincount(text)
    ends = np.cumsum(sizes)
    # The symbol before a suffix, if what begins there is larger (smaller), else -1; empty places end at -1 too.
    larger, smaller = np.full(n + 1, -1), np.full(n + 1, -1)
    larger[1:n] = np.where(small[:-1], -1, text[:-1])
    smaller[1:n] = np.where(small[:-1], text[:-1], -1)
    before = larger.tolist()
    out = [-1] * n
    symbols = text[lms].tolist()
    at = ends.tolist()
    for i, c in zip(lms[::-1].tolist(), reversed(symbols), strict=True):
        at[c] -= 1
        out[at[c]] = i
    at = (ends - sizes).tolist()
    c = int(text[-1])
    out[at[c]] = n - 1
    at[c] += 1
    for i in out:
        c = before[i]
        if c >= 0:
            k = at[c]
            out[k] = i - 1
            at[c] = k + 1
    before = smaller.tolist()
    at = (ends - 1).tolist()
    for k in range(n - 1, -1, -1):
        i = out[k]
        c = before[i]
        if c >= 0:
            k = at[c]
            out[k] = i - 1
            at[c] = k - 1
    return np.array(out, np.int64)


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost smaller substrings in text order, equal ones alike, and how many there are."""
    n = len(text)
    length = np.empty(n + 1, np.int64)
    length[lms] = np.append(lms[1:] + 1, n + 1) - lms
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (a + length[a] <= n) & (b + length[b] <= n)
    at, k = np.flatnonzero(same), 0
    while len(at):
        equal = text[a[at] + k] == text[b[at] + k]
        same[at[~equal]] = False
        k += 1
        at = at[equal]
        at = at[length[a[at]] > k]
    ranks = np.concatenate([[0], np.cumsum(~same)])
    named = np.empty(n + 1, np.int64)
    named[order] = ranks
    return named[lms], int(ranks[-1]) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order: of bytes (uint8), or of names 0, 1, ... (int64).  A suffix comes before those it begins."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    induced = _induced_bytes if text.dtype == np.uint8 else _induced_names
    small, lms = _types(text)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        rough = induced(text, small, lms)
        order = rough[is_lms[rough]]
        names, n_names = _names(text, lms, order)
        if n_names < len(lms):
            lms = lms[suffix_array(names)]
        else:
            lms = order
    return induced(text, small, lms)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, by its start, the bytes it shares with the one before it in order (0 for the first).

    A suffix whose left neighbour's symbol is the same before both shares one byte less than
    the suffix before it in the text; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    known = (at > 0) & (before > 0)
    known[known] = text[at[known] - 1] == text[before[known] - 1]
    alone = np.flatnonzero(~known & (before >= 0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    shared = np.zeros(n, np.int64)
    a, b = alone, before[alone]
    room = n - np.maximum(a, b)
    k = 0
    while len(a):
        differ = words[a + k] ^ words[b + k]
        # The lowest bit that differs tells the first byte that does.
        bits = differ & (~differ + np.uint64(1))
        first = np.where(differ == 0, 8, np.log2(np.maximum(bits, 1).astype(np.float64)).astype(np.int64) >> 3)
        got = np.minimum(first, room - k)
        shared[a] = k + got
        more = (got == 8) & (room > k + 8)
        a, b, room, k = a[more], b[more], room[more], k + 8
    reach = np.zeros(n, np.int64)
    reach[alone] = shared[alone] + alone
    return np.maximum(np.maximum.accumulate(reach) - at, 0) * (before >= 0)
