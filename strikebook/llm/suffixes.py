"""Suffix arrays of integer sequences with numpy, by doubling; used inside tasks on bounded blocks."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in lexicographic order; a suffix that ends sorts before its extensions.

    Suffixes are grouped by ever longer prefixes; only groups that still hold several suffixes are sorted
    again, by the group of the suffix that starts where the known prefix ends.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    values = text.astype(np.int64)
    width = int(values.max()) + 2
    # start with as many symbols as fit into one number
    key, symbols, room = values + 1, 1, (1 << 62) // width
    while room >= width and symbols < min(8, n):
        shifted = np.zeros(n, np.int64)
        shifted[: n - symbols] = values[symbols:] + 1
        key = key * width + shifted
        room //= width
        symbols += 1
    order = np.argsort(key)
    ordered = key[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = group
    step = symbols
    alone = first.copy()
    alone[:-1] &= first[1:]
    places = np.flatnonzero(~alone)
    while len(places):
        starts = order[places]
        head = rank[starts]
        following = rank[np.minimum(starts + step, n)]
        pair = head * (n + 1) + (following + 1)
        by = np.argsort(pair)
        starts, pair, head = starts[by], pair[by], head[by]
        order[places] = starts
        fresh = np.empty(len(places), bool)
        fresh[0] = True
        np.not_equal(pair[1:], pair[:-1], out=fresh[1:])
        new = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[starts] = new
        single = fresh.copy()
        single[:-1] &= fresh[1:]
        places = places[~single]
        step *= 2
    return order
