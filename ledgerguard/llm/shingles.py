"""Hashed words and word shingles of Arrow text batches (numpy inside tasks).

Words are the maximal runs of bytes other than space and tab..carriage return, with A-Z lowered; a
word's hash is a 64-bit polynomial over a random byte table, mixed; a shingle's hash combines the
hashes of its words.  Texts are taken in blocks of about ``BLOCK`` bytes, so memory follows the block
(or one longer text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_rng = np.random.default_rng(20240131)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base=_BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the rows in them)."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1]
    at = at[at < len(data)]
    first[at] = word[at]  # a word does not reach into the next text
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = _BYTE[data[starts[0]:]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, offsets)


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words (over row borders too: callers cut them)."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j:j + n] * _STEP[j]
    return mix(out)


def shingle_sets(column, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted set of shingle hashes of each row).  A text with 1 to k-1 words has one
    shingle, its whole sequence; a text without words has none."""
    for row, data, offsets in blocks(column):
        words, at = word_hashes(data, offsets)
        windows = combine(words, k)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                sets.append(np.unique(windows[a:b - k + 1]))
            elif b > a:
                short = words[a:b] * _STEP[:b - a]
                sets.append(mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                sets.append(words[:0])
        yield row, sets
