"""Words and their 64-bit hashes, computed on whole Arrow string buffers.

ASCII bytes never occur inside a multi-byte UTF-8 character, so the separators
(space, 9 to 13) and the letters A-Z can be handled on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 20

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += _U(32)
_lower += _U(1)  # byte 0 counts too
_separator = np.zeros(256, dtype=bool)
_separator[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n, at = len(texts), texts.offset
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and n else np.empty(0, np.uint8)
    return raw, ends - ends[0] if n else np.zeros(1, np.int64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[_U(1)], np.cumprod(np.full(max(n, 1024), _BASE))]).astype(np.uint64)
    return _powers


def word_blocks(raw: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, bytes inside words, first bytes of words) of blocks of about `most` bytes, cut between words."""
    starts_at = np.zeros(len(raw) + 1, dtype=bool)
    starts_at[ends] = True  # a new text starts a new word
    start, size = 0, len(raw)
    while start < size:
        stop = min(size, start + most)
        step = most
        while stop < size and not (gap := np.flatnonzero(_separator[raw[max(start, stop - step) : stop]])).size:
            stop, step = min(size, stop + most), step + most
        if stop < size:
            stop = max(start, stop - step) + int(gap[-1]) + 1
        inside = ~_separator[raw[start:stop]]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | starts_at[start + 1 : stop]
        yield start, stop, inside, first
        start = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and n + 1 word offsets by row.

    The bytes are taken in blocks cut between words, so temporary arrays stay
    small however long a text is; only a single word longer than a block
    makes a longer one.
    """
    raw, ends = buffers(texts)
    hashes, places = [], []
    for start, stop, inside, first in word_blocks(raw, ends, _BLOCK):
        block = raw[start:stop]
        at = np.flatnonzero(first)
        if at.size:
            index = np.arange(len(block)) - at[np.maximum(np.cumsum(first) - 1, 0)]
            index[~inside] = 0
            power = _power(int(index.max()) + 1)
            value = _lower[block] * power[index]
            value[~inside] = 0
            length = np.add.reduceat(inside, at, dtype=np.uint64)
            hashes.append(mix(np.add.reduceat(value, at) + length * _U(0xD1B54A32D192ED03)))
            places.append(at + start)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), ends, "left")


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, and their offsets.

    A row with fewer words gives its whole sequence as one; without words, none.
    """
    count = np.diff(offsets)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(count)), n)
    start = offsets[row] + np.arange(out_at[-1]) - out_at[row]
    length = np.minimum(count, size)[row]
    value = length.astype(np.uint64)
    for k in range(size):
        here = k < length
        value[here] = mix(value[here] * _U(0x9E3779B97F4A7C15) + words[start[here] + k])
    return value, out_at


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and their offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[a:b].sort()  # rows are contiguous, so no order of all of them is needed
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept[offsets]
