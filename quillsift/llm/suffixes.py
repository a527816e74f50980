"""Suffix arrays of a shard's text by induced sorting, and permuted common prefixes, in numpy.

Induced sorting works through the buckets of first characters in order. Buckets between which nothing is induced are
scanned together, so each step is one array operation; a bucket that induces into itself (runs of one character) takes a
step per character of its longest run.
"""

from __future__ import annotations

import numpy as np


def grouped(keys: np.ndarray) -> np.ndarray:
    """Order by key, equal keys as they come: a radix sort of 16 bits at a time."""
    order = (keys & 0xFFFF).astype(np.uint16).argsort(kind="stable")
    if len(keys) and keys.dtype.itemsize > 2 and (high := keys >> 16).any():
        order = order[high[order].astype(np.uint16).argsort(kind="stable")]
    return order


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last character is the only smallest one."""
    out, at = np.ones(len(text), bool), np.arange(len(text) - 1)
    out[:-1] = text[:-1] < text[1:]
    unlike = np.where(text[:-1] == text[1:], len(text) - 1, at)
    out[:-1] = out[np.minimum.accumulate(unlike[::-1])[::-1]]
    return out


def induce(text: np.ndarray, size: int, want: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Seeds and all suffixes of the wanted type, in order: those of a bucket before its seeds. seeds: in order."""
    wanted = np.flatnonzero(want)
    own, given = np.bincount(text[wanted], minlength=size), np.bincount(text[seeds], minlength=size)
    ends = np.cumsum(own + given)
    starts = ends - own - given
    out = np.empty(ends[-1], np.int32)
    c = text[seeds]
    out[(starts + own - np.cumsum(given) + given)[c] + np.arange(len(seeds))] = seeds
    head = starts.copy()
    reach = np.full(size, size)  # by bucket, the lowest one into which it induces
    np.minimum.at(reach, text[wanted + 1], text[wanted].astype(np.int64))
    reach = np.minimum.accumulate(reach[::-1])[::-1].tolist()
    low = 0
    while low < size:
        high = reach[low]
        alone = high == low
        if alone:
            high, new = low + 1, out[starts[low] : head[low]]
            while len(new):
                new = new[new > 0] - 1
                new = new[want[new] & (text[new] == low)]
                out[head[low] : head[low] + len(new)] = new
                head[low] += len(new)
        j = out[starts[low] : ends[high - 1]]
        j = j[j > 0] - 1
        j = j[want[j]]
        k = text[j]
        if alone:
            j, k = j[k > low], k[k > low]
        if len(j):
            order = grouped(k)
            k = k[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            count = np.diff(np.append(first, len(k)))
            out[np.arange(len(k)) + np.repeat(head[k[first]] - first, count)] = j[order]
            head[k[first]] += count
        low = high
    return out


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of the suffixes of text in order. Characters are below size; the last is the only smallest one."""
    small = types(text)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    flipped, inner = (size - 1 - text.astype(np.int64)).astype(text.dtype), small.copy()
    inner[-1] = False

    def ordered(seeds: np.ndarray) -> np.ndarray:
        large = induce(text, size, ~small, seeds)
        large = large[~small[large]]
        return np.append(induce(flipped, size, inner, large[::-1]), np.int32(len(text) - 1))[::-1]

    if len(text) == 1:
        return np.zeros(1, np.int64)
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    found = ordered(leftmost[grouped(text[leftmost])])
    found = found[is_leftmost[found]]  # by the substring up to the next leftmost smaller one
    length = np.zeros(len(text), np.int64)
    length[leftmost] = np.append(np.diff(leftmost) + 1, 1)
    alike = length[found[1:]] == length[found[:-1]]
    pair, d = np.flatnonzero(alike), 0
    while len(pair):
        same = text[found[pair] + d] == text[found[pair + 1] + d]
        alike[pair[~same]] = False
        d += 1
        pair = pair[same]
        pair = pair[length[found[pair]] > d]
    names = np.zeros(len(text), np.int32)
    names[found] = np.append(0, np.cumsum(~alike))
    count = int(names[found[-1]]) + 1 if len(found) else 0
    if count < len(leftmost):
        found = leftmost[suffix_array(names[leftmost], count)]
    return ordered(found)


def common_prefixes(text: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """By start of a suffix, the length of its common prefix with the one before it in order; characters up to `stop` equal nothing.

    Where the characters before both are equal, it's one less than that of the suffix one to the left; only the others are
    compared.
    """
    before = np.full(len(text), -1)
    before[order[1:]] = order[:-1]
    back = before - 1
    reducible = np.zeros(len(text), bool)
    reducible[1:] = (back[1:] >= 0) & (text[:-1] == text[back[1:]]) & (text[:-1] > stop)
    out = np.zeros(len(text), np.int64)
    live = np.flatnonzero(~reducible & (before >= 0))
    d = 0
    while len(live):
        one = text[live + d]
        live = live[(one > stop) & (one == text[before[live] + d])]
        d += 1
        out[live] = d
    base = np.maximum.accumulate(np.where(reducible, 0, np.arange(len(text))))
    return np.maximum(out[base] - (np.arange(len(text)) - base), 0)
