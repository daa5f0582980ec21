"""Long matches inside a bounded set of pieces, by a run-length index built with numpy.

The Burrows-Wheeler transform of the joined pieces is kept as runs. At the head of each run the suffix
position, its predecessor in suffix order and their common length are sampled. Between samples both follow
by stepping along the text: a suffix that is not at a run head has the predecessor and the match of the
suffix before it, one symbol on. This streams, for every position, the longest match elsewhere and one
place of it; repetitive pieces have few runs.
"""

from __future__ import annotations

import numpy as np

from strikebook.llm.suffixes import suffix_array

#: Stands between pieces; no UTF-8 text holds it.
SEPARATOR = 0xFF


def common_lengths(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b share, eight at a time."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 8, 8), (1, 1))
    length = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(np.maximum(a, b) < n)
    while len(open_):
        x, y = a[open_] + length[open_], b[open_] + length[open_]
        inside = np.minimum(n - np.maximum(x, y), 8)
        same = words[np.minimum(x, n)] == words[np.minimum(y, n)]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        run = np.minimum(run, inside)
        length[open_] += run
        open_ = open_[run == 8]
    return length


class RunIndex:
    """Matching statistics of a text against the rest of itself, from sampled run heads."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        sa = suffix_array(text)
        before = text[sa - 1]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (sa[1:] == 0) | (sa[:-1] == 0)
        rows = np.flatnonzero(head)
        self.run_symbols, self.run_starts = before[rows], rows
        at, previous = sa[rows], sa[rows - 1]
        previous[rows == 0] = n  # the first suffix has none
        order = np.argsort(at)
        self.at, self.previous = at[order], previous[order]
        self.length = common_lengths(text, self.at, self.previous)
        self.n = n

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the length of its match and where that starts, streamed from the samples."""
        sample = np.searchsorted(self.at, np.arange(self.n), side="right") - 1
        ahead = np.arange(self.n) - self.at[sample]
        length = np.maximum(self.length[sample] - ahead, 0)
        return length, np.where(length > 0, self.previous[sample] + ahead, np.arange(self.n))


def repeated_windows(pieces: list[bytes], size: int) -> list[np.ndarray]:
    """For each piece the starts of its windows of ``size`` bytes that an earlier place of the list holds too."""
    joined = bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR])
    text = np.frombuffer(joined, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    length, source = RunIndex(text).statistics()
    long = np.flatnonzero(length >= size)
    piece = np.searchsorted(starts, long, side="right") - 1
    inside = long + size < starts[piece + 1]
    long, piece = long[inside], piece[inside]
    root = np.arange(len(text))
    root[long] = source[long]
    while len(long):
        onward = root[root[long]]
        if (onward == root[long]).all():
            break
        root[long] = onward
    first = np.arange(len(text))
    np.minimum.at(first, root[long], long)
    # every place of a class but the first: members are those in ``long`` and the class's root
    later = long[first[root[long]] != long]
    roots = np.unique(root[long])
    late_roots = roots[first[roots] != roots]
    places = np.sort(np.concatenate([later, late_roots]))
    owner = np.searchsorted(starts, places, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [places[a:b] - starts[i] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
