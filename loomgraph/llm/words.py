"""Vectorised word splitting over whole Arrow text columns.

All texts of a batch are one byte buffer; word boundaries, word hashes and their owners
are found with array operations, so no Python object is made per word. A word's 64-bit
hash is a polynomial over randomised bytes modulo 2**64, passed through a finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import LOWER, mix

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
#: Bytes that part the words of the decontamination contract: ASCII but for digits and letters.
_NOT_ALNUM = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_LOWER = np.frombuffer(LOWER, np.uint8)
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Words are hashed in pieces of the buffer of this size, so that arrays stay in cache.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


_UP, _DOWN = _powers(_P, PIECE + 1), _powers(_P_INVERSE, PIECE + 1)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets (one more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word never crosses from one text into the next."""
    inside = ~(_NOT_ALNUM if alnum else _SPACE)[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    low = _RANDOM[_LOWER]
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + PIECE, "right"))
        if to <= at:  # one word longer than a piece
            out[at] = _long_hash(data[starts[at] : ends[at]], low)
            at += 1
            continue
        piece = low[data[base : ends[to - 1]]]
        piece *= _UP[: len(piece)]
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum(piece, out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * _DOWN[s]
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64))


def _long_hash(word: np.ndarray, low: np.ndarray) -> np.uint64:
    total, factor = 0, 1
    for i in range(0, len(word), PIECE):
        part = low[word[i : i + PIECE]] * _UP[: len(word[i : i + PIECE])]
        total = (total + int(part.sum(dtype=np.uint64)) * factor) & 0xFFFFFFFFFFFFFFFF
        factor = factor * pow(_P, PIECE, 1 << 64) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(total)


def words_of(column: pa.Array, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a column: hash, start, end (in the joined buffer); and the first word of each text, plus the total."""
    data, offsets = buffer_of(column)
    starts, ends = word_bounds(data, offsets, alnum)
    return word_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 3-word shingles and the text of each; a text of one or two words is one shingle."""
    n = np.diff(first)
    count = np.where(n >= 3, n - 2, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    many = n[owner] >= 3
    two = n[owner] == 2
    padded = np.concatenate([h, np.zeros(2, np.uint64)])
    one, second, third = padded[at], padded[at + 1], padded[at + 2]
    second = np.where(many | two, second, np.uint64(0x5851F42D4C957F2D))
    third = np.where(many, third, np.uint64(0x14057B7EF767814F))
    return mix(one * _M[0] + mix(second + _M[1]) * _M[1] + mix(third ^ _M[2]) * _M[2]), owner


def batches_of(batches, n_bytes: int, n_rows: int = 50_000):
    """Arrow batches cut or joined to tables of about ``n_bytes`` and at most ``n_rows`` rows, with contiguous columns."""
    held, size, rows = [], 0, 0
    for batch in batches:
        step = max(1, min(n_rows, int(batch.num_rows * n_bytes / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            if held and (size + part.nbytes > n_bytes or rows + part.num_rows > n_rows):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
            held.append(part)
            size += part.nbytes
            rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
