"""Arrow text columns as flat arrays, and bounded samples of labelled rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that one step of a task holds as arrays at a time; a longer single text is held whole.
SLICE_BYTES = 2 << 20


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and n + 1 offsets. Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary()),
                          "" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` text bytes, at least one row each.

    After every batch its reader's unused memory goes back to the system, as workers are kept for later stages.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        start = 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end
        del batch
        give_back()


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def spread_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df``, chosen by a hash of the key; all rows if there are no more than that."""
    n = df.select(key).count()
    if n <= most:
        return df
    low = F.lit(int(2**62 * (most / n)))
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(key)), 2) < low)


def unused(df: DataFrame, name: str) -> str:
    """The name, with more underscores if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over the whole range (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def give_back() -> None:
    """Return unused memory of Arrow's pool and of the C heap to the system: a worker is reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def per_group(step: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of one group, which leaves no unused memory in its worker."""
    def run(table):
        done = step(table)
        give_back()
        return done
    return run


def per_pair(step: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two co-grouped tables."""
    def run(left, right):
        done = step(left, right)
        give_back()
        return done
    return run
