"""Vectorised text primitives over Arrow string buffers: words, 64-bit word hashes and shingles.

Every function works on the bytes of many documents at once; ``offsets`` marks where each document starts.
A chunk holds about ``CHUNK`` bytes, so a worker's memory doesn't depend on the size of its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so that powers can be inverted modulo 2**64
_powers: dict[str, np.ndarray] = {}

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and every byte beyond ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _byte_values(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(_MUL))
    if fold:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


RAW_BYTES, FOLDED_BYTES = _byte_values(False), _byte_values(True)


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK + 1), base, _U)
        p[0] = 1
        have = _powers[name] = np.cumprod(p, dtype=_U)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = RAW_BYTES) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, _U)
    np.cumsum(values[data] * _power("base", _BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("inverse", pow(_BASE, -1, 1 << 64), n + 1)[starts]
    return mix(h + (ends - starts).astype(_U) * _U(_MUL))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and the offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, offsets = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (one more entry than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[0] = cut[n] = True
    edge = cut.copy()
    edge[1:n] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(inside & edge[:n])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data, offsets, is_word=SPACE_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with A-Z lower-cased, and the index of each document's first word."""
    starts, ends, first = words(data, offsets, is_word)
    return span_hashes(data, starts, ends, FOLDED_BYTES), first


def _place(k: int) -> np.ndarray:
    return mix(np.arange(101, 101 + k, dtype=_U) * _U(_MUL)) | _U(1)


def gram_hashes(words_: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words; the caller leaves out runs that cross documents."""
    n = len(words_) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    c = _place(k)
    h = words_[:n] * c[0]
    for i in range(1, k):
        h += words_[i : n + i] * c[i]
    return mix(h)


def shingles(words_: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each document its shingles in order: runs of k words; with fewer words, the whole sequence as one."""
    grams = gram_hashes(words_, k)
    c = _place(k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield grams[a : b - k + 1]
        elif b > a:
            yield mix((words_[a:b] * c[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a))
        else:
            yield grams[:0]


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def list_column(flat: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat)


def binary_column(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of bytes cut from one array."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat).view(np.uint8))])


def tidy(run):
    """A function over batches that gives memory back once it is through."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns memory that Python has freed to the system, as workers outlive their tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.default_memory_pool().release_unused()
