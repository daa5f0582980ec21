"""Sets of hashed word shingles, computed with numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text hashed together.
CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n + n // 8, CHUNK)
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def byte_sums(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which the hash of any range of bytes follows."""
    powers, _ = _powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)])])


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words between white space (blank and 09-0D)."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts, range_hashes(byte_sums(raw), starts, ends)


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for text in texts:
        some.append((text or "").encode().lower())
        size += len(some[-1]) + 1
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def shingle_sets(texts: list[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """For each text its set as ascending hashes: runs of ``words`` lower-case (A-Z) words; fewer words are one run."""
    multipliers = np.cumprod(np.full(words, _BASE, np.uint64))
    for chunk in _chunks(texts):
        starts, hashes = word_hashes(b"\n".join(chunk))
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in chunk])])
        first = np.searchsorted(starts, bounds)
        n = max(0, len(hashes) - words + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(words):
            runs += hashes[k : k + n] * multipliers[k]
        runs = mixed(runs)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                yield mixed((hashes[a:b] * multipliers[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
