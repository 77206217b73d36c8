"""Documents stored as compressed blocks, and exchanges of packed arrays between blocks and buckets of a hash.

A block holds whole rows with about two MB of text as one Arrow stream. Blocks are written once to the shared folder;
after that a row is known by its block and its place in it, whatever its ids are. What blocks must tell each other
moves as arrays packed per (block, bucket), a few bytes an entry: each block has added up its own entries before, so
a string that every document holds costs one entry a block. There are as many buckets as the text has units of
eight MB, so a bucket's arrays stay small whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrays import slices, text_bytes, tidy_batches, tidy_table
from .common import stored

BLOCK_BYTES = 1 << 21
BUCKET_BYTES = 1 << 23
ROW_BITS, BLOCK_BITS = 24, 16
# Level of the zstd compression of blocks and packed arrays.
LEVEL = 5


def store_blocks(docs: DataFrame, text: str, marks: Callable[[np.ndarray, np.ndarray], bytes] | None = None) -> DataFrame:
    """(block, n_rows, n_bytes, payload, marks): all columns of ``docs`` in blocks; ``marks`` is computed from a
    block's bytes and document offsets."""
    place = docs.columns.index(text)

    def run(batches):
        number = TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for first, last in slices(offsets, BLOCK_BYTES):
                part = batch.slice(first, last - first)
                low, high = offsets[first], offsets[last]
                found = marks(data[low:high], offsets[first:last + 1] - low) if marks else None
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([last - first], pa.int64()),
                    pa.array([int(high - low)], pa.int64()), pa.array([pack_rows(part)], pa.binary()),
                    pa.array([found], pa.binary())], names=["block", "n_rows", "n_bytes", "payload", "marks"])
                number += 1

    return stored(docs.mapInArrow(tidy_batches(run), "block long, n_rows long, n_bytes long, payload binary, marks binary"))


def pack_rows(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec())) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rows_of(payload: bytes) -> pa.Table:
    """The rows of a block."""
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=LEVEL)


def squeeze(array: np.ndarray) -> bytes:
    """Bytes of an array, compressed, behind their length."""
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + (codec().compress(raw, asbytes=True) if raw else b"")


def unsqueeze(data: bytes, kind) -> np.ndarray:
    """The array again."""
    size = int.from_bytes(data[:8], "little")
    raw = codec().decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""
    return np.frombuffer(raw, dtype=kind)


def bucket_count(blocks: DataFrame) -> int:
    """Buckets for the blocks' text; one number reaches the driver."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a 64-bit hash; the lower half tells the hashes of a bucket apart."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def low_half(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def groups_of(sorted_values: np.ndarray) -> np.ndarray:
    """Start of every run of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def by_bucket(buckets_sorted: np.ndarray):
    """(bucket, from, to) of every run in a sorted array of buckets."""
    starts = groups_of(buckets_sorted)
    stops = np.append(starts[1:], len(buckets_sorted))
    return [(int(buckets_sorted[a]), int(a), int(b)) for a, b in zip(starts, stops)]


def found_in(values: np.ndarray, known_sorted: np.ndarray) -> np.ndarray:
    """Place of every value in a sorted array, or -1."""
    if len(known_sorted) == 0:
        return np.full(len(values), -1, np.int64)
    place = np.minimum(np.searchsorted(known_sorted, values), len(known_sorted) - 1)
    return np.where(known_sorted[place] == values, place, -1)


def with_answers(blocks: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """``work(block row, answer rows)`` for every block, with or without answers, as Arrow tables."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_table(work), schema)
