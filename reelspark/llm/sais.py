"""Suffix arrays by induced sorting, in NumPy.

The scans of SA-IS (Nong, Zhang and Chan, 2009) go bucket by bucket: all suffixes of a bucket induce their predecessors in one
step, and predecessors within the same bucket follow in further steps, as many as the longest run of one byte. The string of
the names of the leftmost-smaller substrings has about as many letters as names, so it is sorted by doubling of ranks.
"""
from __future__ import annotations

import numpy as np

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The start positions of a byte string's suffixes in order; the end of the string sorts before every byte."""
    count = len(text)
    if count < 2:
        return np.arange(count, dtype=np.int32)
    smaller = _types(text)
    marks = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    marks = marks.astype(np.int32)
    if len(marks) > 1:
        sorted_marks = _induce(text, smaller, marks)
        is_mark = np.zeros(count, bool)
        is_mark[marks] = True
        sorted_marks = sorted_marks[is_mark[sorted_marks]]
        names, unique = _names(text, marks, sorted_marks)
        # The reduced string: the marks' names in the order of the text
        marks = sorted_marks if unique else marks[_by_doubling(names)]
    return _induce(text, smaller, marks)


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last never is."""
    count = len(text)
    rising = np.zeros(count, bool)
    rising[:-1] = text[:-1] < text[1:]
    differs = np.ones(count, bool)
    differs[:-1] = text[:-1] != text[1:]
    # Equal neighbours are of one type: that of the run's end
    ends = np.flatnonzero(differs)
    return np.repeat(rising[ends], np.diff(np.concatenate(([-1], ends))))


def _induce(text: np.ndarray, smaller: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order (or, of those, only the order of first bytes)."""
    count = len(text)
    sizes = np.bincount(text, minlength=256)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    ends = starts + sizes
    order = np.full(count, -1, np.int32)
    letters = np.flatnonzero(sizes)
    # Marks by bucket, in the order given
    grouped = marks[np.argsort(text[marks], kind="stable")]
    held = np.concatenate(([0], np.cumsum(np.bincount(text[marks], minlength=256))))

    heads = starts.copy()

    def place_larger(found):
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        chars = text[before]
        turn = np.argsort(chars, kind="stable")
        before, chars = before[turn], chars[turn]
        times = np.bincount(chars, minlength=256)
        first = np.cumsum(times) - times
        order[heads[chars] + np.arange(len(chars)) - first[chars]] = before
        np.add(heads, times, out=heads)

    # The end of the text comes before all suffixes and induces the last one
    last = text[count - 1]
    order[heads[last]] = count - 1
    heads[last] += 1
    for letter in letters:
        done = starts[letter]
        while done < heads[letter]:
            reach = heads[letter]
            place_larger(order[done:reach])
            done = reach
        own = grouped[held[letter]:held[letter + 1]]
        if len(own):
            place_larger(own)

    larger_to, tails = heads, ends.copy()

    def place_smaller(found):
        """``found`` in descending order."""
        before = found[found > 0] - 1
        before = before[smaller[before]]
        chars = text[before]
        turn = np.argsort(chars, kind="stable")
        before, chars = before[turn], chars[turn]
        times = np.bincount(chars, minlength=256)
        first = np.cumsum(times) - times
        order[tails[chars] - 1 - (np.arange(len(chars)) - first[chars])] = before
        np.subtract(tails, times, out=tails)

    for letter in letters[::-1]:
        done = ends[letter]
        while done > tails[letter]:
            reach = tails[letter]
            place_smaller(order[reach:done][::-1])
            done = reach
        if larger_to[letter] > starts[letter]:
            place_smaller(order[starts[letter]:larger_to[letter]][::-1])
    return order


def _names(text: np.ndarray, marks: np.ndarray, sorted_marks: np.ndarray):
    """A number for each mark's substring up to the next mark, in the order of the text, and whether all differ."""
    count = len(text)
    ends = np.empty(len(marks), np.int64)
    ends[:-1], ends[-1] = marks[1:] + 1, count
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(count, _BASE))))
    down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(count, np.uint64(pow(int(_BASE), -1, 1 << 64))))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:count])))
    digest = (sums[ends] - sums[marks]) * down[marks]
    index = np.empty(count, np.int32)
    index[marks] = np.arange(len(marks))
    rank = index[sorted_marks]
    length = ends - marks
    differs = np.ones(len(marks), bool)
    differs[1:] = (digest[rank[1:]] != digest[rank[:-1]]) | (length[rank[1:]] != length[rank[:-1]])
    # The last substring reaches the end of the text, which no other does
    last = np.flatnonzero(rank == len(marks) - 1)
    differs[last] = True
    differs[last[last + 1 < len(marks)] + 1] = True
    names = np.empty(len(marks), np.int64)
    names[rank] = np.cumsum(differs)
    return names, bool(differs.all())


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The order of a number string's suffixes; the end sorts first."""
    rank, step = names, 1
    while True:
        after = np.zeros(len(rank), np.int64)
        if step < len(rank):
            after[:-step] = rank[step:]
        pair = rank * (int(rank.max()) + 1) + after
        order = np.argsort(pair, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = pair[order[1:]] != pair[order[:-1]]
        if fresh.all():
            return order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """The permuted common prefixes: for each start position, how many bytes its suffix shares with the one before it in
    ``order``, counted up to ``limit``; -1 for positions that ``order`` leaves out."""
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.full(len(text), -1, np.int64)
    shared[order] = 0
    padded = np.append(text.astype(np.int16), np.full(limit, -1, np.int16))
    live = np.flatnonzero(before >= 0)
    for at in range(limit):
        live = live[(padded[live + at] == padded[before[live] + at]) & (padded[live + at] >= 0)]
        if not len(live):
            break
        shared[live] = at + 1
    return shared
