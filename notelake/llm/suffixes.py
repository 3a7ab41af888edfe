"""Suffix arrays of many short texts at once, by induced sorting.

The texts of a batch are sorted together: a symbol is a text's number and a character,
so the suffixes of one text are one range of the array.  The two induction scans are
sequential within a text and independent between texts; they advance through all texts
in step, one vector operation for a step of all, and the few longest texts are finished
one by one.

``suffix_arrays`` classifies suffixes as L or S, sorts the leftmost-S substrings by
induction, names them, recurs on the texts of names where names repeat, and induces
the arrays from the sorted leftmost-S suffixes, all in linear time.
``common_prefixes`` computes permuted common prefixes: only irreducible positions are
compared, the others are one less than their left neighbour's.
"""

from __future__ import annotations

import numpy as np

from notelake.llm.text import mix

U64 = np.uint64
#: Texts in step below which the rest is done one by one.
FEW = 24


def _types(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """True for S: smaller than the suffix to the right.  ``last``: place of each text's end mark, its smallest symbol."""
    n = len(s)
    differ = np.empty(n, bool)
    differ[:-1] = s[:-1] != s[1:]
    differ[-1] = True
    less = np.empty(n, bool)
    less[:-1] = s[:-1] < s[1:]
    less[last] = True
    at = np.where(differ, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _buckets(s: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    stop = np.cumsum(np.bincount(s, minlength=n_symbols))
    return np.concatenate([[0], stop[:-1]]), stop


def _induce(sa: np.ndarray, s: np.ndarray, base: np.ndarray, size: np.ndarray, go: np.ndarray, ends: np.ndarray, step: int) -> None:
    """One scan: for each entry p in turn with go[p], put p-1 into its bucket.

    step 1: left to right, buckets fill from their heads; -1: right to left, from their tails.
    ``base`` and ``size`` describe the texts, longest first.
    """
    start = base if step > 0 else base + size - 1
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # texts that are longer than i
    i = 0
    put = 0 if step > 0 else -1
    for i in range(len(live)):
        k = live[i]
        if k < FEW:
            break
        p = sa[start[:k] + step * i]
        q = p[go[p]] - 1
        symbol = s[q]
        at = ends[symbol]
        sa[at + put] = q
        ends[symbol] = at + step
    else:
        return
    for g in range(live[i]):  # the longest ones
        lo, hi = int(base[g]), int(base[g] + size[g])
        part, mine, ok = sa[lo:hi].tolist(), s[lo:hi].tolist(), go[lo:hi].tolist()
        low = min(mine)
        end = (ends[low : max(mine) + 1] - lo).tolist()
        none = len(go) - 1
        for j in range(i, hi - lo) if step > 0 else range(hi - lo - 1 - i, -1, -1):
            p = part[j]
            if p != none and ok[p - lo]:
                c = mine[p - 1 - lo] - low
                at = end[c]
                part[at + put] = p - 1
                end[c] = at + step
        sa[lo:hi] = part


def suffix_arrays(s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the suffixes of all texts, each text's in order in the text's own range.

    ``s``: symbols of the texts, longest text first; symbols of a text are larger than
    those of the texts before it, all from 0 on without gaps, and each text ends with
    its smallest symbol, which it has only there.
    """
    n = len(s)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    last = base + size - 1
    small = _types(s, last)
    before = np.concatenate([[True], small[:-1]])
    before[base] = True
    leftmost = np.flatnonzero(small & ~before)
    go_l, go_s = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    go_l[1:n], go_s[1:n] = ~small[: n - 1], small[: n - 1]
    go_l[base] = go_s[base] = False
    head, tail = _buckets(s, int(s.max()) + 1)

    def induced(order: np.ndarray) -> np.ndarray:
        """The array that follows from leftmost-S suffixes in ``order``."""
        sa = np.full(n, n, np.int64)
        symbol = s[order]
        new = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        count = np.diff(np.append(new, len(order)))
        sa[base[size == 1]] = base[size == 1]
        sa[np.repeat(tail[symbol[new]] - count, count) + np.arange(len(order)) - np.repeat(new, count)] = order
        _induce(sa, s, base, size, go_l, head.copy(), 1)
        ends = tail.copy()
        kept = sa.copy()
        s_kind = np.append(small, False)[sa]
        s_kind[base] = False  # the end mark stays first
        kept[s_kind] = n
        _induce(kept, s, base, size, go_s, ends, -1)
        return kept

    sa = induced(leftmost[np.argsort(s[leftmost], kind="stable")])
    # name the leftmost-S substrings in their order
    is_left = np.zeros(n + 1, bool)
    is_left[leftmost] = True
    order = sa[is_left[sa]]
    following = np.append(leftmost[1:], n - 1)
    number = np.searchsorted(leftmost, order)
    ending = np.isin(leftmost, last)
    length = np.where(ending, 1, following - leftmost + 1)[number]
    h = _hash_ranges(s.astype(U64) * U64(2) + small, order, length)
    name_of = np.cumsum(np.concatenate([[False], (h[1:] != h[:-1]) | (length[1:] != length[:-1])]))
    names = np.empty(len(leftmost), np.int64)
    names[number] = name_of
    if name_of[-1] + 1 < len(order):
        text_of = np.searchsorted(base, leftmost, "right") - 1
        sizes = np.bincount(text_of, minlength=len(size))
        # texts of names, longest first again, for those texts alone whose names repeat
        distinct = np.bincount(text_of[number[np.concatenate([[True], name_of[1:] != name_of[:-1]])]], minlength=len(size))
        again = np.flatnonzero(distinct < sizes)
        again = again[np.argsort(-sizes[again], kind="stable")]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pick = np.repeat(first[again] - np.concatenate([[0], np.cumsum(sizes[again])[:-1]]), sizes[again]) + np.arange(sizes[again].sum())
        rank = np.empty(len(size), np.int64)
        rank[again] = np.arange(len(again))
        key = rank[text_of[pick]] * (len(leftmost) + 1) + names[pick]
        _, symbols = np.unique(key, return_inverse=True)
        sub = suffix_arrays(symbols.astype(np.int64), sizes[again])
        sorted_left = pick[sub]  # of each such text in turn, in the order of ``again``
        begin = np.concatenate([[0], np.cumsum(sizes[again])[:-1]])
        result = number.copy()
        # in ``order`` the texts stand in the order of their numbers
        where = np.repeat(first[again] - begin, sizes[again]) + np.arange(len(pick))
        result[where] = sorted_left
        order = leftmost[result]
    return induced(order)


def _hash_ranges(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of the values in each range."""
    b = 0x2545F4914F6CDD1D
    n = len(values)
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, U64(b)), np.full(n + 1, U64(pow(b, -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        sums = np.zeros(n + 1, U64)
        np.cumsum(mix(values + U64(1)) * up[:n], out=sums[1:])
        return mix((sums[start + length] - sums[start]) * down[start])


def common_prefixes(s: np.ndarray, sa: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its left neighbour in the array (-1: none) and the length of their common prefix, in text order."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[base]] = -1
    text_start = np.zeros(n, bool)
    text_start[base] = True
    left = np.arange(n) - 1
    other = np.maximum(phi, 0)
    reducible = (phi >= 0) & ~text_start & ~text_start[other] & (s[left] == s[other - 1])
    reducible[1:] &= phi[:-1] >= 0
    at = np.flatnonzero(~reducible & (phi >= 0))
    end = np.repeat(base + size, size)
    room = np.minimum(end[at] - at, end[phi[at]] - phi[at])
    with np.errstate(over="ignore"):
        b = 0x2545F4914F6CDD1D
        up, down = np.full(n + 1, U64(b)), np.full(n + 1, U64(pow(b, -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        sums = np.zeros(n + 1, U64)
        np.cumsum(mix(s.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        h = np.zeros(len(at), np.int64)
        width = 1 << max(int(room.max(initial=1)).bit_length() - 1, 0)
        other = phi[at]
        while width and len(at):
            some = np.flatnonzero(h + width <= room)
            x, y = at[some] + h[some], other[some] + h[some]
            same = (sums[x + width] - sums[x]) * down[x] == (sums[y + width] - sums[y]) * down[y]
            h[some[same]] += width
            width >>= 1
    value = np.zeros(n, np.int64)
    value[at] = h
    whole = np.zeros(n, np.int64)
    whole[~reducible] = np.flatnonzero(~reducible)
    anchor = np.maximum.accumulate(whole)
    return phi, np.where(phi >= 0, np.maximum(value[anchor] - (np.arange(n) - anchor), 0), 0)
