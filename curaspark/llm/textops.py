"""Vectorised text primitives over Arrow string columns: no Python object per word.

A batch's strings are one UTF-8 buffer with offsets. White space and A-Z are single bytes in UTF-8, so
words `[^\\x20\\x09-\\x0D]+` are found on the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; bounds the memory of every numpy pass below.
CHUNK_BYTES = 512 << 10

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    return raw, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in raw, and n+1 offsets into them by row. off starts at 0; white: the bytes between words."""
    solid = ~white[raw]
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Longer words are hashed one by one with XXH3.
LONG_WORD = 64


def word_blocks(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """(n, words) little-endian numbers of 8 bytes: the first 8 * n bytes of each word, zeros after its end.

    With its length, they are the word itself if it is not longer than that.
    """
    out = np.zeros((n, len(starts)), np.uint64)
    at = np.arange(len(starts))
    left = stops - starts
    view = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    for j in range(n):
        if j:
            at = at[left[at] > 8 * j]
            if not len(at):
                break
        out[j, at] = view[starts[at] + 8 * j] & _MASKS[np.minimum(left[at] - 8 * j, 8)]
    return out


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: a finaliser over the length and each 8 bytes, XXH3 for words over LONG_WORD bytes.

    Words of up to 8 bytes have equal hashes only if they are equal or differ in length. Other seeds are independent hashes.
    """
    n = stops - starts
    out = mix(n.astype(np.uint64) + _U((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % 2**64))
    if not len(n):
        return out
    blocks = word_blocks(raw, starts, stops, min(LONG_WORD, -(-int(n.max()) // 8) * 8) // 8)
    at = np.arange(len(n))
    for j, block in enumerate(blocks):
        at = at[n[at] > 8 * j]
        out[at] = mix(out[at] ^ block[at])
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : stops[i]].tobytes(), seed)
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, for every start that has n words after it in the array.

    Sums of the words' finalised hashes, each at its place; the finaliser is no linear function of the place.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += mix(h + _U((j + 1) * int(_BASE) % 2**64))[j : j + m]
    return mix(out)


def joined(raw: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by one space: the bytes, each word's start and end there, and offsets into the words by row."""
    starts, stops, rows = words(raw, off)
    if not len(starts):
        return b"", starts, stops, rows
    length = stops - starts
    ends = np.cumsum(length + 1) - 1
    begins = ends - length
    keep = ~WHITE[raw]
    out = np.full(int(ends[-1]) + 1, 32, np.uint8)
    hole = np.ones(len(out), bool)
    hole[ends] = False
    out[hole] = raw[keep]
    return out.tobytes(), begins, ends, rows
