"""Words of Arrow text columns as arrays, without a Python object per word or row.

A word becomes a 64-bit number: the sum of a random value of each byte times an odd power of its place, then mixed.
The tables come from a fixed seed, so numbers agree between tasks and runs.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

#: Text bytes worked on at once; a longer word is still taken whole.
CHUNK = 1 << 20
_rng = np.random.default_rng(20240611)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _classes(separator) -> np.ndarray:
    """For each byte 0 if it separates words, else the byte with A-Z lowered."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for b in range(128):
        if separator(int(out[b])):
            out[b] = 0
    return out


SPACED = _classes(lambda b: b == 0x20 or 9 <= b <= 13)
SPACED[0] = 255  # NUL belongs to a word here; 255 never occurs in UTF-8
ALNUM = _classes(lambda b: not (48 <= b <= 57 or 97 <= b <= 122))


def powers(step: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(_STEP, 4096)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string or binary column; a null takes none."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_numbers(column: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows in order, and the n + 1 places where each row's words begin."""
    data, offsets = raw(column)
    parts, begins = [], []
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):  # move to the next place where a word can't go on
            while end < len(data):
                stop = np.flatnonzero(classes[data[end : end + CHUNK]] == 0)
                if len(stop):
                    end += int(stop[0])
                    break
                end = min(end + CHUNK, len(data))
        c = classes[data[at:end]]
        solid = c != 0
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        first[rows] = solid[rows]
        starts = np.flatnonzero(first)
        if len(starts):
            packed = c[solid]
            where = np.cumsum(solid, dtype=np.int64)[starts] - 1
            lengths = np.diff(where, append=len(packed))
            place = np.arange(len(packed)) - np.repeat(where, lengths)
            table = _POWERS if lengths.max() <= len(_POWERS) else powers(_STEP, int(lengths.max()))
            parts.append(mix(np.add.reduceat(_VALUES[packed] * table[place], where)))
            begins.append(starts + at)
        at = end
    numbers = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    begins = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return numbers, np.searchsorted(begins, offsets)


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Parts of a batch with about most bytes of text each, at least one row."""
    _, offsets = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """What a worker has freed goes back to the system: workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def parts(batches, column: str, most: int):
    """The slices of all batches; memory is given back after each batch."""
    for batch in batches:
        yield from slices(batch, column, most)
        give_back()
