"""Vectorised kernels over the buffers of Arrow string columns: spans of words and their 64-bit hashes, without a Python object a word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another system
    _libc = None

#: Spans up to so many bytes are hashed and compared word by word over all spans at once, longer ones one at a time.
SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def release() -> None:
    """Give memory that is free back to the system: workers live long, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 places where they begin and end. Nulls count as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def releasing(items: Iterator, every: int = 8) -> Iterator:
    """The items. Memory that is free goes back when so many of them are done with, and at the end; after each of them, the page faults that follow cost about a tenth of the work."""
    for k, item in enumerate(items):
        yield item
        if k % every == every - 1:
            release()
    release()


def parts(col: pa.Array, limit: int = 1 << 20, most_rows: int = 1 << 31) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each slice of a column, of at most so many rows."""
    data, offsets = buffers(col)
    for i, j in releasing((a, min(a + most_rows, end)) for start, end in slices(offsets, limit) for a in range(start, end, most_rows)):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the table marks, within rows; and the first run of each row (n + 1)."""
    inside = table[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros stand behind the last byte."""
    held = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), np.uint64, held, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes. Each word of 8 bytes is multiplied and the state rotated, so no algebra over the bytes' places makes spans collide."""
    n = ends - starts
    words = _words(data)
    h = (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(0, SHORT, 8):
        at = np.flatnonzero((n > k) & (n <= SHORT))
        if not len(at):
            break
        x = h[at] ^ ((words[starts[at] + k] & _MASKS[np.minimum(n[at] - k, 8)]) * np.uint64(0x9E3779B97F4A7C15))
        x = ((x << np.uint64(29)) | (x >> np.uint64(35))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h[at] = x ^ (x >> np.uint64(32))
    for i in np.flatnonzero(n > SHORT).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Are the n bytes of a from a_at on those of b from b_at on? For each of the spans."""
    x, y, same = _words(a), _words(b), np.ones(len(n), bool)
    for k in range(0, SHORT, 8):
        at = np.flatnonzero(n > k)
        if not len(at):
            break
        same[at] &= (x[a_at[at] + k] ^ y[b_at[at] + k]) & _MASKS[np.minimum(n[at] - k, 8)] == 0
    for i in np.flatnonzero(same & (n > SHORT)).tolist():
        same[i] = np.array_equal(a[a_at[i] : a_at[i] + n[i]], b[b_at[i] : b_at[i] + n[i]])
    return same


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` neighbours in h within rows (first: n + 1), and the row offsets of the results.

    A row of 1 to width - 1 elements gives one hash of them all; an empty row gives none.
    """
    n = np.diff(first)
    out_n = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    off = np.concatenate(([0], np.cumsum(out_n)))
    at = np.repeat(first[:-1] - off[:-1], out_n) + np.arange(off[-1])
    end = np.repeat(first[1:], out_n)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    factor = np.uint64(0xA0761D6478BD642F)
    for k in range(width):
        total = (total ^ np.where(at + k < end, padded[at + k], np.uint64(k + 1))) * factor
        total ^= total >> np.uint64(29)
    return mix(total), off


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of all (s, n), one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat.take(at)


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
