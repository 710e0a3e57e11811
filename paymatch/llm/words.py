"""Words and word shingles as 64-bit hashes, vectorised over Arrow batches.

A word is a maximal run of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); letters A-Z count as a-z. Null texts are empty.
Work goes piece by piece (about one megabyte, cut at white space), so very
long texts need no more than a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def _pieces(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(raw):
        to = min(at + _PIECE, len(raw))
        if to < len(raw):
            # move the cut to the next text boundary or white space
            bound = int(ends[np.searchsorted(ends, to)])
            while to < bound:
                hit = np.flatnonzero(_SPACE[raw[to:min(to + 4096, bound)]])
                if len(hit):
                    to += int(hit[0])
                    break
                to = min(to + 4096, bound)
        yield at, to
        at = to


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a string column, and the word offsets of each row."""
    raw, ends = bytes_of(column)
    hashes, places = [], []
    for at, to in _pieces(raw, ends):
        piece = raw[at:to]
        word = ~_SPACE[piece]
        start = word.copy()
        start[1:] &= ~word[:-1]
        inner = ends[np.searchsorted(ends, at, "right"):np.searchsorted(ends, to)] - at
        start[inner] = word[inner]
        here = np.flatnonzero(word)
        if not len(here):
            continue
        first = np.flatnonzero(start[here])
        length = np.diff(np.append(first, len(here)))
        place = np.arange(len(here)) - np.repeat(first, length)
        power = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
        total = np.add.reduceat(_BYTE[_LOWER[piece[here]]] * power[place], first)
        hashes.append(mix(total + length.astype(np.uint64)))
        places.append(here[first] + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), ends)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Per row the sorted distinct shingle hashes; fewer words: the sequence as one; none: empty."""
    words, at = word_hashes(column)
    n = len(words) - SHINGLE + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        rolled += words[k:k + n] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a:b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.sum(words[a:b] * _PLACE[:b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(rolled[:0])
    return out
