"""Sets of word shingles as sorted 64-bit hashes, for whole chunks of texts at once."""

from __future__ import annotations

import numpy as np

from sigloom.llm._common import splitmix

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)
_PLACE = splitmix(np.arange(1001, 1001 + 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); A-Z count as a-z."""
    n = len(offs) - 1
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~_SPACE[buf]
    first = np.empty(len(buf), bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[offs[:-1][offs[:-1] < len(buf)]] = True
    starts = np.flatnonzero(first & inside)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    packed = _LOWER[buf[inside]]
    at = np.cumsum(inside)[starts] - 1
    lengths = np.diff(np.append(at, len(packed)))
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()) - 1, _BASE, np.uint64))), dtype=np.uint64)
    place = np.arange(len(packed)) - np.repeat(at, lengths)
    h = np.add.reduceat(_BYTE[packed] * powers[place], at)
    owner = np.searchsorted(offs, starts, "right") - 1
    return splitmix(h ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), np.bincount(owner, minlength=n)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted and distinct within each text, bounds): text i has hashes[bounds[i]:bounds[i+1]].

    With fewer than ``words`` words, the whole sequence is one shingle; without words, the set is empty.
    """
    h, count = word_hashes(buf, offs)
    n = len(count)
    begin = np.cumsum(count) - count
    size = np.where(count >= words, count - words + 1, (count > 0).astype(count.dtype))
    bounds = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])
    used = np.repeat(np.minimum(count, words), size)
    total = used.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    padded = np.concatenate((h, np.zeros(words, np.uint64)))
    short = bool((size > 0).any() and int(used.min()) < words)
    for k in range(words):
        term = padded[at + k] * _PLACE[k]
        total = total + (np.where(used > k, term, np.uint64(0)) if short else term)
    total = splitmix(total)
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            total[a:b].sort()
    keep = np.ones(len(total), bool)
    if len(total) > 1:
        keep[1:] = total[1:] != total[:-1]
        keep[bounds[:-1][size > 0]] = True
    owner = np.repeat(np.arange(n), size)[keep]
    return total[keep], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
