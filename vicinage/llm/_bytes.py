"""Vectorised byte and word work over Arrow text columns, shared by the operators that run in Python.

A batch of texts is one ``uint8`` buffer plus offsets, taken from the Arrow column without copying
a string object per row. Every helper works on blocks of a few megabytes, so memory is bounded by
the block and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and one odd base for polynomial hashes.
BYTE_VALUES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of words: space and the controls 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def _powers_upto(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, BLOCK_BYTES * 3 // 2), BASE_INV if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)``; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block_bytes, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each text the index of its first word (with an end mark)."""
    inside = ~separators[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Running polynomial hash modulo 2**64: ``span_hash`` then gives any substring's hash in constant time."""
    values = BYTE_VALUES[LOWER] if fold_case else BYTE_VALUES
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * _powers_upto(len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal values wherever they stand."""
    raw = (running[ends] - running[starts]) * _powers_upto(len(running), inverse=True)[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block, and the index of each text's first word (with an end mark)."""
    starts, ends, bounds = word_spans(data, offsets, separators)
    return span_hash(prefix_hash(data, fold_case), starts, ends), bounds


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words that start at each word; the last ``k - 1`` entries run over the end and mean nothing."""
    out = np.zeros(len(words), dtype=np.uint64)
    for j in range(k):
        out *= U64(0x9FB21C651E98DF25)
        out[: len(words) - j] += words[j:]
    return mix64(out)
