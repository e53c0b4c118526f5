"""The Burrows-Wheeler transform and common prefixes of many short strings, column by column.

Round j puts the suffix of length j of every string that has one into the sorted
collection of all suffixes, by one symbol per string: the transform holds, for every
suffix in sorted order, the symbol before it, and the new suffixes are the images of
the symbols that stand before the suffixes of the last round.  So a new suffix's place
is the number of smaller symbols plus the number of equal ones further up.  The common
prefix of a new suffix with its neighbour is one symbol longer than what the suffixes
behind their first symbols have in common, a minimum over the prefixes between them.

Each round reads the arrays of the round before in order and writes new ones in order.
They hold a bounded collection, so they stay in a task's memory: files of a task
would be lost with its executor.

A symbol is one byte or ``width`` consecutive ones.  In wide symbols a string is ``width``
strings, one from each of its first ``width`` places, so that every suffix is still there,
without the bytes at its end that fill no symbol.  The collection has as many symbols as
before, but rounds for a ``width``-th of the bytes only.
"""
from __future__ import annotations

import numpy as np


#: Bytes of the widest symbol; symbols of up to 16 bits are sorted by counting.
WIDEST = 8


def _symbols(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes): ``width`` strings for each, as dense symbols from 1 in the order of
    their bytes, one string after the other, and the numbers of their symbols; 0 stands before a whole string."""
    lengths = np.array([len(s) for s in strings], np.int64)
    sizes = np.maximum((lengths[:, None] - np.arange(width)) // width, 0).reshape(-1)
    full = np.maximum(lengths - width + 1, 0)  # places where a symbol starts
    string = np.repeat(np.arange(len(strings)), full)
    place = np.arange(len(string)) - (np.cumsum(full) - full)[string]
    data = np.frombuffer(b"".join(strings), np.uint8)
    first = (np.cumsum(lengths) - lengths)[string] + place
    value = np.zeros(len(first), np.uint64)
    for k in range(width):
        value = value << np.uint64(8) | data[first + k]
    different, number = np.unique(value, return_inverse=True)
    flat = np.empty(len(value), np.uint8 if len(different) < 256 else np.uint16 if len(different) < 65536 else np.uint32)
    flat[(np.cumsum(sizes) - sizes)[string * width + place % width] + place // width] = number + 1
    return flat, sizes


def build(strings: list[bytes], width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common, owner, size): for all suffixes in sorted order, the empty ones first and
    equal ones by the number of their string: the symbol before it (0: none), the length that
    it has in common with the one before, its string and its own length.  In symbols of ``width``
    bytes string i has the numbers from i * width, and lengths are in symbols."""
    return _transform(*_symbols(strings, width))


def _transform(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = len(sizes)
    rounds = int(sizes.max(initial=0))
    ends = np.cumsum(sizes)
    bits = 8 * flat.dtype.itemsize
    kind = np.uint32 if rounds < 1 << (32 - bits) else np.uint64
    low, shift = kind((1 << bits) - 1), kind(bits)

    def before(string: np.ndarray, j: int) -> np.ndarray:
        """The symbols before the suffixes of length j."""
        out = np.zeros(len(string), kind)
        more = sizes[string] > j
        out[more] = flat[ends[string[more]] - 1 - j]
        return out

    # one number for each suffix in sorted order: its common prefix above, its symbol in the low bits
    both = before(np.arange(m), 0)
    at, string = np.arange(m), np.arange(m)  # places and strings of the last round's suffixes, by place
    number = np.empty(len(flat) + m, np.int32)  # of the last round's suffixes, at their places
    for j in range(1, rounds + 1):
        live = sizes[string] >= j
        at, string = at[live], string[live]
        n, ended = len(both), int((sizes < j).sum())
        symbols = both.astype(flat.dtype)
        order = np.argsort(symbols, kind="stable")  # places by symbol: by image
        last = np.zeros(n, bool)
        last[at] = True
        rank = np.flatnonzero(last[order])  # images of the last round's suffixes
        place = order[rank]
        number[at] = np.arange(len(at))
        new = number[place]
        string = string[new]
        mine = symbols[place]
        left, right = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, n - 1)]
        has_left, has_right = (rank > 0) & (symbols[left] == mine), (rank < n - 1) & (symbols[right] == mine)
        # what lies between neighbours with the same symbol: (left, place] and (place, right], from the last
        # place to the first, as reduceat goes over what lies between one right and a left further up
        edges, by = np.empty((len(rank), 3), np.int64), len(rank) - 1 - new
        edges[by, 0], edges[by, 1], edges[by, 2] = np.where(has_left, left, place) + 1, place + 1, np.where(has_right, right, place) + 1
        least = (np.minimum.reduceat(np.append(both, kind(0)), edges.reshape(-1)).reshape(-1, 3) >> shift)[by]
        with_left, with_right = np.where(has_left, least[:, 0] + kind(1), kind(0)), np.where(has_right, least[:, 1] + kind(1), kind(0))
        at = m + rank - ended
        old = np.ones(n + len(at), bool)
        old[at] = False
        woven = np.empty(len(old), kind)
        woven[old], woven[at] = both, with_left << shift | before(string, j)
        next_ = at + 1
        inside = next_ < len(old)
        next_ = next_[inside]
        woven[next_] = with_right[inside] << shift | woven[next_] & low
        both = woven
    symbols, common = both.astype(flat.dtype), (both >> shift).astype(np.int64)
    # the places of all suffixes of a string: images of images
    owner, size = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int32)
    image = np.empty(len(symbols), np.int64)
    image[np.argsort(symbols, kind="stable")] = np.arange(len(symbols)) + m - np.count_nonzero(symbols == 0)
    at = string = np.arange(m)
    for j in range(rounds + 1):
        owner[at], size[at] = string, j
        more = sizes[string] > j
        string = string[more]
        at = image[at[more]]
    return symbols, common, owner, size


def repeated(strings: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each string the starts of its substrings of ``length`` that the collection holds more than once;
    a string of weight w stands for w equal ones."""
    for width in range(min(WIDEST, length), 0, -1):  # the widest that divides the length and has few symbols
        if length % width == 0:
            flat, sizes = _symbols(strings, width)
            if flat.itemsize <= 2:
                break
    _, common, owner, size = _transform(flat, sizes)
    group = np.cumsum(common < length // width)  # neighbours that share ``length`` bytes
    total = np.bincount(group, np.array(weights, np.float64)[owner // width])
    hit = (size >= length // width) & (total[group] > 1)
    start = (sizes[owner[hit]] - size[hit]) * width + owner[hit] % width
    owner = owner[hit] // width
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    return np.split(start, np.searchsorted(owner, np.arange(1, len(strings))))
