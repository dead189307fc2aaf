"""NumPy kernels over Arrow text columns, shared by the corpus operators.

A kernel sees a whole Arrow batch as one byte buffer with row offsets, so the
work per word or per byte is a vector operation and no Python code runs per row.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that a kernel handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)


def _lut(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes outside words: white space, or everything but digits, lower-case letters and non-ASCII.
WHITE = _lut([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row offsets (one more than rows), from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, of about `limit` text bytes each; none for an empty batch."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) // limit) if len(lengths) else lengths
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Gives freed memory back to the system: workers are kept between tasks, and what they hold on to adds up."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of all batches in order; after each batch its memory is given back."""
    for batch in batches:
        yield from slices(batch, column, limit)
        del batch
        tidy()


def pieces(text: bytes, outside: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about `limit` bytes, cut at bytes that are in no word (`outside`), so no word is split."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data):
            gap = np.flatnonzero(outside[data[end : end + limit]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + limit, len(data))
        yield text[at:end]
        at = end


class Words:
    """The words of a batch: byte ranges (`start`, `end`), first word of each row (`first`, one more than rows)."""

    def __init__(self, column: pa.Array, outside: np.ndarray = WHITE, lower: bool = False):
        data, offsets = text_buffer(column)
        self.data = LOWER[data] if lower else data
        inside = ~outside[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        head, tail = offsets[:-1][full], offsets[1:][full] - 1
        begins[head] = inside[head]
        ends[tail] = inside[tail]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)

    @property
    def last(self) -> np.ndarray:
        """For each word, the index after the last word of its row."""
        return np.repeat(self.first[1:], self.per_row)

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """A code for each word and the distinct words by code. Exact: Arrow compares the bytes."""
        if not len(self):
            return np.zeros(0, np.int64), []
        bounds = np.empty(2 * len(self), np.int64)  # word, gap, word, gap, ... word
        bounds[::2], bounds[1::2] = self.start, self.end
        pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.data))])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()[::2].astype(np.int64)
        used = np.zeros(len(coded.dictionary), bool)  # the gaps have codes too
        used[codes] = True
        return (np.cumsum(used) - 1)[codes], coded.dictionary.filter(pa.array(used)).to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        codes, distinct = self.codes()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes] if distinct else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = (h ^ (h >> _32)) * _M2
    h = (h ^ (h >> _32)) * _M2
    return h ^ (h >> _32)


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts (not commutative)."""
    return mix(a * _M1 + (b ^ (b >> _32)))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items, by doubling; len(h) - n + 1 of them. Runs that cross rows are the caller's to skip."""
    if n < 1 or len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power[: len(h) - n + 1] if out is None else chain(out, power[done : done + len(h) - n + 1])
            done += size
        if (size << 1) > n:
            return out
        power = chain(power[:-size], power[size:])
        size <<= 1


def slide(values: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """The best of each n consecutive values."""
    size = 1
    while 2 * size <= n:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (n - size)], values[n - size :]) if n > size else values


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i is data[offsets[i]:offsets[i+1]] as bytes."""
    offsets = np.ascontiguousarray(offsets, np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
