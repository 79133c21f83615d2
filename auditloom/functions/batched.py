"""Column functions over Arrow batches, for what the JVM's list functions do character by character."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts, and bytes of texts, that one step counts together.
STEP_ROWS, STEP_BYTES = 1024, 1 << 20


def _codes(part: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters of all texts as numbers, the characters of each text, and a bound of the numbers."""
    raw = part.to_pylist()
    body = b"".join(raw)
    if body.isascii():
        return np.frombuffer(body, np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)), 128
    own = [t.decode("utf-8", "replace") for t in raw]
    return np.frombuffer("".join(own).encode("utf-32-le"), "<u4"), np.fromiter(map(len, own), np.int64, len(own)), 0x110000


def _entropies(part: pa.Array) -> np.ndarray:
    """Bits per character of each text: log2(n) minus the mean of log2 of how often its characters occur."""
    code, n, bound = _codes(part)
    key = np.repeat(np.arange(len(n)), n) * bound + code
    if bound == 128:
        counts = np.bincount(key, minlength=len(n) * bound)
        which = np.flatnonzero(counts)
        counts = counts[which].astype(np.float64)
    else:
        which, counts = np.unique(key, return_counts=True)
    total = np.bincount(which // bound, counts * np.log2(counts), minlength=len(n))
    safe = np.maximum(n, 1)
    # Texts of one repeated character get 0, not a negative rounding error.
    return np.maximum(np.log2(safe) - total / safe, 0.0)


def steps(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with at most ``STEP_ROWS`` rows and about ``STEP_BYTES`` bytes; a longer text is one range."""
    part = np.maximum.accumulate(np.cumsum(lengths) // STEP_BYTES) * (len(lengths) // STEP_ROWS + 1) + np.arange(len(lengths)) // STEP_ROWS
    cut = (np.flatnonzero(np.diff(part)) + 1).tolist()
    return [(a, b) for a, b in zip([0, *cut], [*cut, len(lengths)]) if a < b]


def entropy(q: Column) -> Column:
    """``text.entropy`` for many rows at a time: the same value up to the order of a sum, 0 for null and empty texts."""
    @F.arrow_udf("double")
    def counted(c: pa.Array) -> pa.Array:
        body = pc.fill_null(c.cast(pa.large_binary()), b"")
        size = pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [_entropies(body.slice(a, b - a)) for a, b in steps(size)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return counted(q)
