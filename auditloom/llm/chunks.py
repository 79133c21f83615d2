"""Chunks of documents that exchange sorted key sets.

Finding equal pieces of text by one row per piece would shuffle many times the size of the texts. Here the texts are
shuffled once, into chunks of neighbouring document ids. A chunk deals the sorted distinct keys of its pieces over key
buckets, packed; a bucket sees the keys of all chunks and answers each chunk with one bit per key, in the same order, so
that neither ids nor positions travel. A key that a third of all documents share is one entry per chunk. Lost tasks are
simply computed again: the order of a set does not depend on the order of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import flat, mixed, per_group, per_pair

#: Average text bytes of a chunk, and average packed bytes of a bucket.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: Draws of the sketch of ids for a chunk's bytes.
DRAWS = 256
ANSWER = "_chunk int, bucket int, round int, bits binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, passed_on: list[str] | None = None) -> tuple[DataFrame, int]:
    """doc_id, text, ``_chunk`` and, renamed ``_p0``, ``_p1``, ..., the columns to be passed on; all text bytes.

    Chunks are ranges of doc_id, in order: every id of a chunk is below every id of the next one; null ids come last. The
    cuts are quantiles by bytes (a bounded sketch of ids, drawn in proportion to the bytes, gives them). An id that fills
    whole chunks by itself, and null ids, are dealt over several chunks by a hash of the text; ``_range`` numbers the ranges
    of ids, which is the same for these chunks and rises with the id.
    """
    id_ = F.col("doc_id").cast("long")
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0))
    size = docs.agg(F.coalesce(F.sum(bytes_), F.lit(0)).alias("b"), F.count("*").alias("n"),
                    F.coalesce(F.sum(F.when(id_.isNull(), bytes_)), F.lit(0)).alias("no_id")).first()
    n = max(1, -(-int(size["b"]) // chunk_bytes), min(8, size["n"]))
    steps = [k / n for k in range(1, n)]
    unit = max(1.0, size["b"] / n / DRAWS)
    drawn = docs.select(id_.alias("_id"), F.floor(bytes_ / F.lit(unit) + F.rand(7)).cast("int").alias("_times")).where("_id is not null and _times > 0")
    drawn = drawn.select("_id", F.explode(F.sequence(F.lit(1), "_times")))
    cuts = drawn.agg(F.percentile_approx("_id", steps, max(10_000, 20 * n)).alias("c")).first()["c"] if steps else []
    first, parts = ranges(np.array(cuts or [], np.int64), -(-int(size["no_id"]) * n // max(1, int(size["b"]))))
    chunk = np.cumsum(parts) - parts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spread = b.column("doc_id"), b.column("_spread").to_numpy()
            at = np.searchsorted(first, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            at[ids.is_null().to_numpy(zero_copy_only=False)] = len(parts) - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array((chunk[at] + spread % parts[at]).astype(np.int32)), pa.array(at.astype(np.int32))],
                                             [*b.schema.names[:-1], "_chunk", "_range"])

    rows = docs.select(id_.alias("doc_id"), "text", *[F.col(f"`{c}`").alias(f"_p{k}") for k, c in enumerate(passed_on or [])])
    schema = T.StructType([*rows.schema.fields, T.StructField("_chunk", T.IntegerType()), T.StructField("_range", T.IntegerType())])
    spread = F.pmod(F.xxhash64("text"), F.lit(2**31 - 1)).alias("_spread")
    return rows.select("*", spread).mapInArrow(place, schema), int(size["b"])


def ranges(cuts: np.ndarray, without_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the second range of ids and all later ones begin, and the chunks of every range, null ids (the last) included.

    A value that is k > 1 of the cuts has k - 1 to k + 1 chunks' bytes: a range of its own, in k + 1 chunks.
    """
    value, times = np.unique(cuts, return_counts=True)
    own = value[(times > 1) & (value < np.iinfo(np.int64).max)]
    first = np.union1d(value, own + 1)
    parts = np.ones(len(first) + 2, np.int64)
    heavy = np.flatnonzero(times > 1)
    parts[np.searchsorted(first, value[heavy], side="right")] = times[heavy] + 1
    parts[-1] = max(1, without_id)
    return first, parts


def bucket_bits(packed_bytes: int) -> int:
    """Number of leading key bits that name a bucket."""
    return max(4, int(np.ceil(np.log2(max(1, packed_bytes / BUCKET_BYTES)))))


def dealt(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each bucket that sorted keys fall into."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)
    return [(int(bucket[s]), int(s), int(e)) for s, e in zip(edge[:-1], edge[1:])]


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def answers(table: pa.Table, which: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The answered bit of each of a chunk's sorted keys; a bucket without an answer is all zero."""
    out = np.zeros(len(keys), bool)
    got = {b: data for b, r, data in zip(*(table.column(c).to_pylist() for c in ("bucket", "round", "bits"))) if r == which}
    for b, s, e in dealt(keys, bits):
        if b in got:
            out[s:e] = unpacked(got[b], e - s)
    return out


def asked(texts: DataFrame, schema: str, ask: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What every chunk asks, from its rows alone."""
    return texts.groupBy("_chunk").applyInArrow(per_group(ask), schema)


def told(texts: DataFrame, replies: DataFrame, schema: str, use: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """What every chunk makes of its rows and the answers to it."""
    return texts.groupBy("_chunk").cogroup(replies.groupBy("_chunk")).applyInArrow(per_pair(use), schema)


def bytes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return flat(table.column("text"))


# Words -------------------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20_240)
LETTER = mixed(_rng.integers(1, 2**63, 256, dtype=np.uint64))
STEP, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, n - 1), STEP)])


def words(body: np.ndarray, at: np.ndarray, piece: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first and last-plus-one byte of every word (a run without space or one of the bytes 9 to 13).

    Hashes are computed for about ``piece`` bytes at a time.
    """
    blank = BLANK[body]
    border = np.zeros(len(body) + 1, bool)
    border[at[(at < len(body))]] = True
    border[-1] = True
    before = np.r_[True, blank[:-1]] | border[:-1]
    begin = np.flatnonzero(~blank & before)
    after = np.r_[blank[1:], True] | border[1:]
    end = np.flatnonzero(~blank & after) + 1
    del before, after, border
    out = np.empty(len(begin), np.uint64)
    size = end - begin
    power = powers(int(size.max(initial=1)))
    part = begin // piece
    for s, e in zip(*(lambda x: (x[:-1], x[1:]))(np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(begin)])):
        if s == e:
            continue
        n = size[s:e]
        first = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        value = LETTER[body[inside + np.repeat(begin[s:e], n)]] * power[inside]
        out[s:e] = np.add.reduceat(value, first)
    out = mixed(out + size.astype(np.uint64) * NEXT)
    return out, np.searchsorted(at, begin, side="right") - 1, begin, end


def windows(values: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``width`` consecutive values from each place on, and whether they lie in one row."""
    n = max(0, len(values) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * STEP + values[j:j + n]
    return mixed(h), row[:n] == row[width - 1:width - 1 + n]
