"""Text columns as numpy arrays: bytes, words and hashes of a batch, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Bytes of text that are worked on at a time inside a task; the arrays of one slice are some 30 times as big.
SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = pow(int(BASE), -1, 1 << 64)


def release() -> None:
    """Give freed memory back to the system: workers are used again, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy_batches(run: Callable) -> Callable:
    """The same function over batches, which releases memory behind each of its batches."""
    def tidy(batches):
        for out in run(batches):
            yield out
            release()
    return tidy


def tidy_table(work: Callable) -> Callable:
    """The same function of one or two tables, which releases memory behind them."""
    def one(table: pa.Table) -> pa.Table:
        out = work(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    return two if work.__code__.co_argcount == 2 else one


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one document behind the other, and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    large = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset:large.offset + len(large) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = large.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes together, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", np.uint64(_INVERSE))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


def prefix_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    """len + 1 sums of byte * base ** place modulo 2 ** 64; every substring's hash follows from two of them."""
    powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of the substrings [start, end)."""
    return mixed((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << np.uint8(5))


def word_spans(data: np.ndarray, offsets: np.ndarray,
               solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all words; words end at bytes that are not ``solid``, by default the six
    white-space bytes, and at a document's end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    if solid is None:
        solid = (data != 32) & ((data < 9) | (data > 13))
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | border[1:])) + 1
    documents = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, documents


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of every word data[start:end), and the different words in the order of their numbers. Words are told
    apart by their bytes; they ascend and do not overlap."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
    found = found.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    number, words = distinct_words(data, starts, ends)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[number]
