"""Word shingles of whole Arrow batches as 64-bit hashes.

Words are runs of bytes outside ``\\x20\\x09-\\x0D``; A-Z are lower-cased.  A
word's hash is a polynomial over a random byte table modulo 2**64, read off a
running sum over the bytes of many documents at once; a shingle mixes the
hashes of its words.  Two different shingles of one pair of documents share a
hash with probability about 2**-64.

A shingle may come with the sum of its words' levels, so that shingles of rare
words can be told from shingles of common ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)]
_CHUNK = 1 << 18

_table = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_table[65:91] = _table[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, long enough for ``size`` bytes."""
    if not _powers or len(_powers["up"]) < size:
        length = max(2 * _CHUNK, size)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.full(length, base, np.uint64))
    return _powers["up"][:size], _powers["down"][:size]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data`` (bytes)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table[data] * up, out=total[1:])
    white = np.concatenate(([True], _WHITE[data], [True]))
    edges = np.flatnonzero(white[1:] != white[:-1])
    first, last = edges[0::2], edges[1::2]
    return _finish((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)), first


def _sets(words: np.ndarray, bounds: np.ndarray, levels: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Sorted distinct shingles of the documents between word ``bounds``, and their word levels."""
    mixed = np.zeros(0, np.uint64)
    total = None if levels is None else np.concatenate(([0], np.cumsum(levels, dtype=np.int64)))
    if len(words) >= WIDTH:
        mixed = words[: len(words) - WIDTH + 1] * _MIX[0]
        for i in range(1, WIDTH):
            mixed = mixed * _MIX[3] + words[i : len(words) - WIDTH + 1 + i] * _MIX[i % 5]
        mixed = _finish(mixed)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WIDTH:
            own = mixed[a : b - WIDTH + 1]
            if total is None:
                own = np.sort(own)
                yield own[np.concatenate(([True], own[1:] != own[:-1]))], None
            else:
                order = np.argsort(own, kind="stable")
                own = own[order]
                new = np.concatenate(([True], own[1:] != own[:-1]))
                at = a + order[new]
                yield own[new], total[at + WIDTH] - total[at]
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = (short * _MIX[4]) ^ w  # array scalars wrap without complaint under errstate
            yield _finish(np.array([short], np.uint64)), None if total is None else np.array([total[b] - total[a]])
        else:
            yield np.zeros(0, np.uint64), None if total is None else np.zeros(0, np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of consecutive texts, and where each text's words begin and end."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < _CHUNK):
            size += len(texts[stop]) + 1
            stop += 1
        data = np.frombuffer(b" ".join(texts[start:stop]) + b" ", np.uint8)
        words, first = word_hashes(data)
        yield words, np.searchsorted(first, np.cumsum([0] + [len(t) + 1 for t in texts[start:stop]]))
        start = stop


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; empty without words."""
    for words, bounds in _chunks(texts):
        with np.errstate(over="ignore"):
            yield from (tokens for tokens, _ in _sets(words, bounds, None))


def counted_sets(texts: list[bytes], counts: np.ndarray) -> Iterator[np.ndarray]:
    """As ``shingle_sets``; adds every word to its cell of ``counts``."""
    for words, bounds in _chunks(texts):
        np.add.at(counts, cells(words, len(counts)), 1)
        with np.errstate(over="ignore"):
            yield from (tokens for tokens, _ in _sets(words, bounds, None))


def levelled_sets(texts: list[bytes], levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle set of each text, with the sum of the ``levels`` of each shingle's words."""
    for words, bounds in _chunks(texts):
        with np.errstate(over="ignore"):
            yield from _sets(words, bounds, levels[cells(words, len(levels))])


def cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """Cell of each hash in a table of ``size`` cells."""
    return (hashes >> np.uint64(20)).astype(np.int64) % size
