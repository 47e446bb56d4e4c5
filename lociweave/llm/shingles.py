"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

#: Bytes that separate words: space and tab to carriage return.
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER += 1  # so that a NUL byte counts too
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 19


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(_BASE)
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(4096)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` in order, and the byte at which each begins.

    A word ends at a separator or where the next text (``starts``) begins. A-Z
    count as a-z.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SEP[data]
    first = np.zeros(len(data), bool)
    first[starts[starts < len(data)]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), at
    nth = np.cumsum(begin) - 1
    place = np.arange(len(data)) - at[np.maximum(nth, 0)]
    place[~inside] = 0
    longest = int(place.max()) + 1
    pw = _POW if longest <= len(_POW) else _powers(longest)
    value = _LOWER[data] * pw[place]
    value[~inside] = 0
    return mix64(np.add.reduceat(value, at)), at


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about half a megabyte; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _PIECE, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``n``-word shingles.

    A text of fewer than ``n`` words has its whole sequence as one shingle, one
    without words has none.
    """
    factor = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    for i, j in pieces(offsets):
        lo = offsets[i]
        starts = offsets[i:j] - lo
        words, at = word_hashes(data[lo : offsets[j]], starts)
        cuts = np.searchsorted(at, np.append(starts, offsets[j] - lo))
        total = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for k in range(n):
            total += words[k : k + len(total)] * factor[k]
        total = mix64(total)
        for k in range(j - i):
            a, b = cuts[k], cuts[k + 1]
            if b - a >= n:
                yield np.unique(total[a : b - n + 1])
            elif b > a:
                w = words[a:b]
                yield mix64(np.array([int(np.sum(w * factor[: b - a])) + int(b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
