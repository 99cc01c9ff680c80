"""Suffix arrays by induced sorting, with whole buckets moved at a time.

The algorithm is the linear one: classify suffixes, sort the substrings between leftmost smaller positions by
inducing, name them, sort the string of names, and induce all suffixes from that order.  Inducing runs over the
alphabet: everything that a bucket induces is placed at once, and what lands in the same bucket follows in waves.
The string of names is sorted the same way while its alphabet is small, and by doubling ranks where it is wide.
"""

from __future__ import annotations

import numpy as np

_INDEX = np.int32  # a text that is sorted at once stays far below 2**31 symbols
NARROW = 512  # alphabets up to here are induced; wider ones are sorted by doubling


def _classes(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol is the sentinel."""
    n = len(text)
    rises = np.append(text[:-1] < text[1:], True)
    at = np.arange(n, dtype=_INDEX)
    at[:-1][text[:-1] == text[1:]] = n
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def _by_symbol(symbols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the counts, and each element's rank within its symbol."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=k)
    rank = np.arange(len(symbols), dtype=_INDEX) - np.repeat((np.cumsum(counts) - counts).astype(_INDEX), counts)
    return order, counts, rank


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes, induced from seeds that are in order within each bucket."""
    n = len(text)
    sizes = np.bincount(text, minlength=k)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.full(n, -1, _INDEX)
    order, seeded, rank = _by_symbol(text[seeds], k)
    out[np.repeat(ends - seeded, seeded) + rank] = seeds[order]
    del order, rank

    heads = begins.copy()

    def forward(found: np.ndarray) -> None:
        j = found - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            order, counts, rank = _by_symbol(text[j], k)
            out[np.repeat(heads, counts) + rank] = j[order]
            np.add(heads, counts, out=heads)

    for c in np.flatnonzero(sizes):
        done = begins[c]
        while done < heads[c]:
            upto = heads[c]
            forward(out[done:upto])
            done = upto
        if seeded[c]:
            forward(out[ends[c] - seeded[c] : ends[c]])

    tails = ends.copy()

    def backward(found: np.ndarray) -> None:
        j = found[::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            order, counts, rank = _by_symbol(text[j], k)
            out[np.repeat(tails, counts) - 1 - rank] = j[order]
            np.subtract(tails, counts, out=tails)

    out[0] = n - 1  # the sentinel is a bucket of its own
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c]
        if c == 0:
            break
        while done > tails[c]:
            upto = tails[c]
            backward(out[upto:done])
            done = upto
        backward(out[begins[c] : heads[c]])
    return out


def _names(text: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of leftmost-smaller substrings in their induced order: equal substrings share one."""
    a, b = ordered[:-1], ordered[1:]
    differs = length[a] != length[b]
    open_ = np.flatnonzero(~differs)
    offset = 0
    while len(open_):
        unequal = text[a[open_] + offset] != text[b[open_] + offset]
        differs[open_[unequal]] = True
        offset += 1
        open_ = open_[~unequal]
        open_ = open_[length[a[open_]] > offset]
    return np.r_[0, np.cumsum(differs)]


def _double(ranks: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string of ranks, looking `depth` symbols deep (None: to the end)."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    first = np.r_[True, ranks[order][1:] != ranks[order][:-1]]
    rank = np.empty(n + 1, np.int64)  # two ranks make a 64-bit key
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[n] = -1
    step = 1
    while depth is None or step < depth:
        starts = np.flatnonzero(first)
        tied = np.repeat(np.diff(np.r_[starts, n]) > 1, np.diff(np.r_[starts, n]))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        who = order[at]
        key = rank[who] << 32 | (rank[np.minimum(who + step, n)] + 1)
        turn = np.argsort(key, kind="stable")
        who, key = who[turn], key[turn]
        order[at] = who
        new = np.r_[True, key[1:] != key[:-1]]
        first[at] = new
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2
    return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes of `text` (whole numbers from 0) in order.

    With a depth, suffixes equal in that many symbols may stand in any order, and stand together.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    k = int(text.max()) + 2
    symbols = np.zeros(n + 1, np.uint8 if k <= 256 else np.uint16 if k <= 65_536 else np.int64)
    np.add(text, 1, out=symbols[:-1], casting="unsafe")
    text = symbols
    small = _classes(text)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_INDEX)
    is_leftmost = np.zeros(n + 1, bool)
    is_leftmost[leftmost] = True
    found = _induce(text, small, leftmost, k)
    ordered = found[is_leftmost[found]]
    del found, is_leftmost
    length = np.zeros(n + 1, _INDEX)
    length[leftmost] = np.diff(np.r_[leftmost, n]) + 1
    names = _names(text, ordered, length)
    del length
    if names[-1] + 1 < len(ordered):
        name_at = np.zeros(n + 1, _INDEX)
        name_at[ordered] = names
        reduced = name_at[leftmost]
        del name_at
        inner = None if depth is None else depth // 2 + 2
        ordered = leftmost[suffix_array(reduced, inner) if names[-1] < NARROW else _double(reduced, inner)]
    return _induce(text, small, ordered, k)[1:]


def repeats(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Valid starts whose next `length` symbols also begin at an earlier valid start.

    Common prefixes are kept by text position: each start is compared with the one before it in suffix order.
    """
    out = np.zeros(len(text), bool)
    order = suffix_array(text, length)
    order = order[valid[order]]
    if len(order) < 2:
        return out
    before = np.full(len(text), -1, _INDEX)
    before[order[1:]] = order[:-1]
    common = np.zeros(len(text), np.int16)
    words = np.lib.stride_tricks.as_strided(np.r_[text, np.zeros(8, np.uint8)], (len(text), 8), (1, 1)).copy().view(np.uint64).ravel()
    here = np.sort(order[1:])
    for offset in [*range(0, length - 8, 8), length - 8]:  # the last step may overlap the one before
        here = here[words[here + offset] == words[before[here] + offset]]
        common[here] = offset + 8
    new = common[order] < length
    earliest = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    out[order] = order != earliest
    return out
