"""Words, lines and their hashes for whole Arrow batches of texts, without a Python step per word.

Texts stay UTF-8 bytes. A chunk is a run of whole texts of about `CHUNK_BYTES` (a longer text is a
chunk by itself), so the working arrays are bounded by the chunk and the longest text. Null texts
count as empty. Sequence hashes are differences of prefix sums, one multiplication per sequence;
they are 64-bit, and callers that need certainty beyond that pair two of them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_power_cache: dict[int, np.ndarray] = {}


def free_memory() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_table(separators: str | bytes) -> np.ndarray:
    """Truth per byte: True where the byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators if isinstance(separators, bytes) else separators.encode())] = False
    return table


SPACE_WORDS = byte_table(b" \t\n\v\f\r")
LINES = byte_table(b"\n")
ALNUM_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals lower-cased; byte positions stay."""
    out = LOWER[buf]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BYTE_BASE)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    known = _power_cache.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 4 * CHUNK_BYTES:
            _power_cache[base] = known
    return known[:n]


def _span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts])


def byte_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _span_hash(_BYTE_VALUE[buf], starts, ends, _BYTE_BASE)


def sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _span_hash(values, starts, ends, _WORD_BASE)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets) of runs of whole texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True bytes; no run crosses a text's border."""
    inside = table[buf]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    border = offsets[(offsets > 0) & (offsets < n)]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in `starts` at which each text begins, and its length at the end."""
    return np.searchsorted(starts, offsets)


def windows(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of all runs of k neighbours that stay within one text; `bounds` as of per_text."""
    n = int(bounds[-1])
    if n < k:
        return np.zeros(0, np.int64)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return np.flatnonzero(room >= k)


def owner(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The text of each position."""
    return np.searchsorted(bounds, positions, side="right") - 1


def count_in(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """True at each of n positions that some run [start, start + length) covers."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
