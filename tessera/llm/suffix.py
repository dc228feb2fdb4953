"""Two-stage suffix sorting of a block of bytes, and what repeats in it."""

from __future__ import annotations

import numpy as np

#: Blocks up to this size sort slices; larger ones refine by a few bytes at a time, which needs less memory.
SLICED = 1 << 19


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one after it. The last is larger than the empty one."""
    change = np.flatnonzero(t[:-1] != t[1:])
    out = np.zeros(len(t), bool)
    if len(change):
        until = change[-1] + 1
        out[:until] = (t[change] < t[change + 1])[np.searchsorted(change, np.arange(until))]
    return out


STEP = 7


def padded(data: bytes, depth: int) -> np.ndarray:
    """The bytes plus one, and zeros after them: the end is smaller than any byte."""
    return np.r_[np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), np.zeros(depth + STEP, np.uint64)]


def words_at(symbols: np.ndarray, at: np.ndarray, n: int = STEP) -> np.ndarray:
    """n symbols of nine bits from each place as one number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = (out << np.uint64(9)) | symbols[at + i]
    return out


def sorted_directly(data: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at these places by their first depth bytes."""
    if len(data) <= SLICED:
        places = at.tolist()
        slices = [data[i : i + depth] for i in places]
        return at[np.array(sorted(range(len(places)), key=slices.__getitem__), np.int64)] if places else at
    symbols = padded(data, depth)
    order = at.copy()
    group = np.zeros(len(order), np.int64)
    open_ = np.arange(len(order))
    for d in range(0, depth, STEP):
        if not len(open_):
            break
        key = words_at(symbols, order[open_] + d)
        by = np.lexsort((key, group[open_]))
        order[open_], key = order[open_][by], key[by]
        before = group[open_]
        new = np.r_[True, (before[1:] != before[:-1]) | (key[1:] != key[:-1])]
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        alone = new & np.r_[new[1:], True]
        open_ = open_[~alone]
    return order


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """All suffixes by their first depth bytes at least: the smaller-than-successor ones sorted directly, the others induced.

    Scanning the buckets of first bytes from the smallest, every suffix that has its place puts the one
    before it, if that is larger, at the front of its bucket. A bucket's own new entries are scanned in waves.
    """
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(t)
    size = np.bincount(t, minlength=256)
    start = np.r_[0, np.cumsum(size)]
    n_small = np.bincount(t[small], minlength=256)
    direct = sorted_directly(data, np.flatnonzero(small), depth)
    sa = np.full(n, -1, np.int64)
    behind = start[1:] - n_small
    own = np.r_[0, np.cumsum(n_small)]
    sa[np.repeat(behind - own[:-1], n_small) + np.arange(len(direct))] = direct
    head = start[:-1].copy()

    def induce(placed: np.ndarray) -> None:
        j = placed - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            c = t[j]
            by = np.argsort(c, kind="stable")
            j, c = j[by], c[by]
            count = np.bincount(c, minlength=256)
            first = np.cumsum(count) - count
            sa[head[c] + np.arange(len(j)) - first[c]] = j
            head[:] += count

    head[t[n - 1]] += 1  # the empty suffix comes before all and puts the last one first
    sa[start[t[n - 1]]] = n - 1
    for c in np.flatnonzero(size):
        at = start[c]
        while at < head[c]:
            wave = sa[at : head[c]].copy()
            at = head[c]
            induce(wave)
        if n_small[c]:
            induce(sa[behind[c] : start[c + 1]])
    return sa


def common(data: bytes, sa: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of sa but the first shares its first depth bytes with the one before it."""
    symbols = padded(data, depth)
    same = np.ones(max(0, len(sa) - 1), bool)
    open_ = np.arange(len(same))
    for d in range(0, depth, STEP):
        n = min(STEP, depth - d)
        a, b = words_at(symbols, sa[open_] + d, n), words_at(symbols, sa[open_ + 1] + d, n)
        equal = a == b
        same[open_[~equal]] = False
        open_ = open_[equal]
        if not len(open_):
            break
    return same


#: The owner of a part that several owners have.
SEVERAL = 0


def of_several(run: np.ndarray, group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each entry, whether those with the same run and group have two owners at least."""
    order = np.lexsort((group, run))
    r, g, o = run[order], group[order], owner[order]
    start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])])
    least = np.minimum.reduceat(np.where(o == SEVERAL, np.iinfo(np.int64).min, o), start)
    most = np.maximum.reduceat(np.where(o == SEVERAL, np.iinfo(np.int64).max, o), start)
    out = np.zeros(len(run), bool)
    out[order] = np.repeat(least != most, np.diff(np.r_[start, len(run)]))
    return out


def repeated_windows(parts: list[bytes], window: int, groups: list[int] | None = None, owners: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each part the first and the last start of a window that also stands elsewhere in the parts; (-1, -1) if none.

    With groups and owners of the parts, elsewhere is in a part of the same group and of another owner.
    """
    data = b"".join(parts)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(parts)), size)
    offset = np.arange(len(data)) - begin[which]
    sa = suffix_array(data, window)
    sa = sa[offset[sa] + window <= size[which[sa]]]
    twice = np.zeros(len(sa), bool)
    same = common(data, sa, window)
    twice[1:] |= same
    twice[:-1] |= same
    if owners is not None and twice.any():
        part, run = which[sa], np.cumsum(np.r_[True, ~same])
        twice = of_several(run, np.array(groups, np.int64)[part], np.array(owners, np.int64)[part])
    hit = sa[twice]
    first, last = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), -1)
    np.minimum.at(first, which[hit], offset[hit])
    np.maximum.at(last, which[hit], offset[hit])
    first[last < 0] = -1
    return first, last
