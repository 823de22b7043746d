"""Vectorised byte and word arithmetic over Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute

#: A-Z to a-z on bytes; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(16, int(n).bit_length()))


class Prefix:
    """Prefix sums of a sequence of uint64 values; ``span`` hashes any ranges of it alike."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64) * up[:n], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    """Random odd 64-bit values of bytes, so that short strings spread over all bits."""
    return _BYTE[data]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, or the bytes of a binary one, and the row offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    large = pa.large_binary() if binary else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(large) if column.type != large else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 256 << 10) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about ``most`` bytes of text; long rows stand alone.

    The default keeps the 8-byte arrays made from a slice within a core's cache.
    """
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.array(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def give_back() -> None:
    """Return memory that this worker no longer uses to the system; workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _malloc_trim()) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _malloc_trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the space-separated words, and the first word of each row (n+1 long)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_HEAD = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time, and ranges of over 64 bytes by prefix sums."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place
    h = mix((eight[starts] & _HEAD[np.minimum(size, 8)]) + size.astype(np.uint64) * _BASE)
    todo, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(todo):
        left = size[todo] - done
        h[todo] = mix((h[todo] ^ (eight[starts[todo] + done] & _HEAD[np.minimum(left, 8)])) * _BASE)
        todo, done = todo[left > 8], done + 8
    if len(long := np.flatnonzero(size > _LONG)):
        h[long] = Prefix(byte_values(data)).span(starts[long], ends[long])
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (van Herk / Gil-Werman)."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    v = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


_OUTER = np.zeros(256, bool)
_OUTER[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without up to ``most`` outer ASCII signs on either side; no word becomes empty."""
    for _ in range(most if len(starts) else 0):
        starts = starts + ((starts < ends - 1) & _OUTER[data[starts]])
        ends = ends - ((starts < ends - 1) & _OUTER[data[ends - 1]])
    return starts, ends


def runs_inside(offsets: np.ndarray, width: int) -> np.ndarray:
    """For each place, whether the ``width`` places from it lie in one row."""
    size = np.diff(offsets)
    starts = np.maximum(size - width + 1, 0)
    return np.repeat(np.tile([True, False], len(size)), np.stack([starts, size - starts], axis=1).ravel())
