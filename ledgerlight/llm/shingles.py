"""Word shingles of UTF-8 text as 64-bit hashes, computed with numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
WORDS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers; a longer call has the same first numbers."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE = stream(256, 1)[LOWER]          # A-Z count as a-z
WORD_CODE = stream(WORDS, 3) | np.uint64(1)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES; a longer text is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, min(stop, n)
        row = min(stop, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word in `data`, which holds the rows that `offsets` (from 0) bound."""
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    firsts = offsets[:-1][(offsets[:-1] < offsets[1:])]
    start[firsts] = ~space[firsts]
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = start[inside]
    at = np.flatnonzero(begins)
    starts = inside[at]
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    values = BYTE_CODE[data[inside]] * (stream(int(lengths.max()), 2) | np.uint64(1))[place]
    hashes = mixed(np.add.reduceat(values, at) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    new = np.empty(len(codes), bool)
    new[:1] = True
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes: WORDS words each; a shorter text is one shingle, no words none."""
    data, offsets = buffers(column)
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        with np.errstate(over="ignore"):
            words, rows = word_hashes(data[base:offsets[hi]], offsets[lo:hi + 1] - base)
            bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
            codes = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
            for j in range(WORDS):
                codes += words[j:j + len(codes)] * WORD_CODE[j]
            codes = mixed(codes)
            for r in range(hi - lo):
                a, b = bounds[r], bounds[r + 1]
                if b - a >= WORDS:
                    yield distinct(codes[a:b - WORDS + 1])
                elif b > a:
                    yield mixed((words[a:b] * WORD_CODE[:b - a]).sum(keepdims=True) + np.uint64(b - a))
                else:
                    yield np.zeros(0, np.uint64)


def set_key(codes: np.ndarray) -> int:
    """64-bit key of a shingle set, equal for equal sets; as a signed number."""
    with np.errstate(over="ignore"):
        return int(mixed(codes.sum(keepdims=True) + np.uint64(len(codes)))[0].view(np.int64))
