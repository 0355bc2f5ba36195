"""A run-length index of byte strings: a run-compressed Burrows-Wheeler transform with sampled run ends.

The strings are concatenated, each with an end mark of its own that sorts below all bytes, and their
suffixes are put in order. Where the symbol before a suffix differs from that before its predecessor
in that order, a run of the transform begins. Only there are samples kept: the suffix's place, its
predecessor's place (the end of the run before), and how many bytes the two share.

Between samples nothing need be kept: within a run, stepping one symbol back keeps neighbours
neighbours. So walking a string from a sample, each step moves the predecessor along by one and
shortens what is shared by one, until the next sample. These are the matching statistics of the
strings against each other, streamed from as many samples as there are runs.
"""

from __future__ import annotations

import numpy as np

#: Symbols that the first order looks at. The low byte of a key holds how many are before the end mark.
_FIRST = 7


def _first_keys(text: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """The next _FIRST bytes of each place, zero beyond the end mark, and how many there are."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(_FIRST, dtype=np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(_FIRST):
        key = (key << np.uint64(8)) | np.where(to_end > k, padded[k : k + n], 0).astype(np.uint64)
    return (key << np.uint64(8)) | np.minimum(to_end, _FIRST).astype(np.uint64)


def suffix_order(text: np.ndarray, to_end: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Places of text by the suffix that begins there. to_end: bytes up to the end mark, 0 on the
    mark. Marks differ, by piece, so no two suffixes are equal. Prefix doubling; only ties are sorted on."""
    n = len(text)
    key = _first_keys(text, to_end)
    tie = np.where(to_end < _FIRST, piece + 1, 0)
    order = np.lexsort((tie, key))
    k, t = key[order], tie[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    del key, tie, k, t
    # a rank is the slot of the first suffix that is not told apart yet
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    span = _FIRST
    alone = new.copy()
    alone[:-1] &= new[1:]
    slots = np.flatnonzero(~alone)
    while len(slots):
        places = order[slots]
        own, then = rank[places], rank[np.minimum(places + span, n - 1)]
        by = np.argsort(own * n + then)
        places, own, then = places[by], own[by], then[by]
        order[slots] = places
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
        rank[places] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        span *= 2
    return order


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes are equal from a and b on, at most most."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, dtype=np.uint8)]), 8)
    out = np.zeros(len(a), dtype=np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = words[a[open_] + out[open_]], words[b[open_] + out[open_]]
        differ = x != y
        some = differ.any(axis=1)
        out[open_] = np.minimum(out[open_] + np.where(some, differ.argmax(axis=1), 8), most[open_])
        open_ = open_[~some & (out[open_] < most[open_])]
    return out


def samples(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of the transform of the strings data[at[i]:at[i + 1]], but for the first: place,
    predecessor's place and shared bytes, ordered by place; places count an end mark after each
    string. Then the strings' numbers by place, and their first places (one more at the end)."""
    lengths = np.diff(at)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = int(first[-1])
    piece = np.repeat(np.arange(len(lengths)), lengths + 1)
    to_end = first[piece + 1] - 1 - np.arange(n)
    text = np.zeros(n, dtype=np.uint8)
    text[to_end > 0] = data
    order = suffix_order(text, to_end, piece)
    # the transform: the symbol before; before a string stands a mark, which equals no other symbol
    before = text[order - 1]
    starts = np.ones(n, dtype=bool)
    is_first = order == first[piece[order]]
    starts[1:] = (before[1:] != before[:-1]) | is_first[1:] | is_first[:-1]
    runs = np.flatnonzero(starts)[1:]
    place, other = order[runs], order[runs - 1]
    by = np.argsort(place)
    place, other = place[by], other[by]
    return place, other, _shared(text, place, other, np.minimum(to_end[place], to_end[other])), piece, first


def long_matches(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """String and place therein of every substring of length bytes that stands elsewhere as well."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, other, shared, piece, first = samples(data, at)
    n = int(first[-1])
    # a sample holds up to the next one; the match is long enough while shared bytes last
    until = np.append(place[1:], n)
    times = np.minimum(until - place, shared - length + 1)
    some = times > 0
    depth = np.zeros(n + 1, dtype=np.int64)
    for begin in (place[some], other[some]):
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + times[some], -1)
    hit = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
    return piece[hit], hit - first[piece[hit]]
