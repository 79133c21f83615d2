"""Substring de-duplication with fixed-block anchors.

A window of ``WINDOW`` words is removed from a document if the same words start in a document with a smaller id. The
non-overlapping blocks of ``BLOCK`` words of every document are the index: blocks are so short that any repeated window
holds a whole block of the other document. Every rolling run of ``BLOCK`` words probes the index (round 1); a run that
hits a block of another document, and the block itself, are anchors. Anchors are extended to all windows around them;
the windows' hashes are matched (round 2), and runs of matching windows are the maximal repeats.

Documents are dealt into chunks of neighbouring ids (see ``chunks``), so a window has a smaller source if it occurs in a
chunk of an earlier range of ids, or in its own chunk with a smaller id (chunks of one range hold one id). Words are compared by 64-bit hashes of their bytes.

Defined results: a null text has no words; a document shorter than a window keeps all words; rows with equal ids do not
remove one another's words, whether repeated or not; a null id is larger than all others; other columns are not read; an
empty table gives an empty table. Windows are judged on the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import chunks as C
from auditloom.llm.common import per_group

WINDOW = 13
#: Two blocks less one word fit in a window, so a window holds a whole block wherever blocks begin.
BLOCK = (WINDOW + 1) // 2
PROBES = "_chunk int, bucket int, keys binary, blocks binary, several binary"
WINDOWS = "_chunk int, _range int, bucket int, keys binary"
LAST = np.iinfo(np.int64).max


class Chunk:
    """Words and windows of a chunk's documents."""

    def __init__(self, table: pa.Table):
        self.number, self.range = (table.column(c)[0].as_py() for c in ("_chunk", "_range"))
        self.body, self.at = C.bytes_of(table)
        ids = table.column("doc_id")
        self.ids = ids.fill_null(0).to_numpy()
        self.rank = np.where(ids.is_null().to_numpy(), LAST, self.ids)
        self.null = ids.is_null().to_numpy()
        self.word, self.row, self.begin, self.end = C.words(self.body, self.at)
        self.first = np.searchsorted(self.row, np.arange(len(self.at)))

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct runs of a block's length, place of each run among them (-1: none), the runs themselves."""
        h, ok = C.windows(self.word, self.row, BLOCK)
        keys, place = np.unique(h[ok], return_inverse=True)
        at = np.full(len(h), -1, np.int64)
        at[ok] = place
        return keys, at, ok

    def candidates(self, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows that hold an anchor, their sorted distinct hashes, and the place among these."""
        h, ok = C.windows(self.word, self.row, WINDOW)
        anchor = np.zeros(len(self.word) + 1, np.int64)
        anchor[1:len(at) + 1] = (at >= 0) & hit[at] if len(hit) else False
        seen = np.cumsum(anchor)
        reach = np.minimum(np.arange(len(h)) + WINDOW - BLOCK + 1, len(at))
        start = np.flatnonzero(ok & (seen[reach] > seen[np.arange(len(h))]))
        keys, place = np.unique(h[start], return_inverse=True)
        return start, keys, place


def unkeyed(h: np.ndarray, bits: int) -> np.ndarray:
    """The 32 key bits behind the bucket's bits."""
    return ((h << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def ask_blocks(bits: int):
    def ask(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        keys, at, ok = c.probes()
        index = np.flatnonzero(ok)
        place = at[index]
        block = np.zeros(len(keys), bool)
        block[place[(index - c.first[c.row[index]]) % BLOCK == 0]] = True
        low, high = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, place, c.rank[c.row[index]])
        np.maximum.at(high, place, c.rank[c.row[index]])
        several = low != high
        cuts = C.dealt(keys, bits)
        return pa.table({"_chunk": pa.array([c.number] * len(cuts), pa.int32()), "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
                         "keys": pa.array([unkeyed(keys[s:e], bits).tobytes() for _, s, e in cuts], pa.binary()),
                         "blocks": pa.array([C.packed(block[s:e]) for _, s, e in cuts], pa.binary()),
                         "several": pa.array([C.packed(several[s:e]) for _, s, e in cuts], pa.binary())})
    return ask


def merged(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a bucket: sorted distinct ones, place of every key among them, in how many sets each occurs."""
    every = np.concatenate(columns) if columns else np.zeros(0, np.uint64)
    keys, place = np.unique(every, return_inverse=True)
    return keys, place, np.bincount(place, minlength=len(keys))


def match_blocks(table: pa.Table) -> pa.Table:
    """An anchor occurs in two documents at least, in one of them as a block."""
    sets = [np.frombuffer(k.as_py(), "<u4") for k in table.column("keys")]
    keys, place, n = merged(sets)
    block, several = (np.concatenate([C.unpacked(x.as_py(), len(s)) for x, s in zip(table.column(c), sets)]) for c in ("blocks", "several"))
    good = (np.bincount(place, block, len(keys)) > 0) & ((n > 1) | (np.bincount(place, several, len(keys)) > 0))
    return replies(table, np.cumsum([0, *map(len, sets)]), good[place], 1)


def replies(table: pa.Table, at: np.ndarray, bit: np.ndarray, which: int) -> pa.Table:
    """One answer per asking chunk, if any of its bits is set."""
    rows = [k for k in range(table.num_rows) if bit[at[k]:at[k + 1]].any()]
    chunk, bucket = table.column("_chunk").to_pylist(), table.column("bucket").to_pylist()
    return pa.table({"_chunk": pa.array([chunk[k] for k in rows], pa.int32()), "bucket": pa.array([bucket[k] for k in rows], pa.int32()),
                     "round": pa.array([which] * len(rows), pa.int32()),
                     "bits": pa.array([C.packed(bit[at[k]:at[k + 1]]) for k in rows], pa.binary())})


def ask_windows(bits: int):
    def ask(table: pa.Table, replies_: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], pa.binary() if n == "keys" else pa.int32()) for n in ("_chunk", "_range", "bucket", "keys")})
        c = Chunk(table)
        probes, at, _ = c.probes()
        _, keys, _ = c.candidates(C.answers(replies_, 1, probes, bits), at)
        cuts = C.dealt(keys, bits)
        return pa.table({"_chunk": pa.array([c.number] * len(cuts), pa.int32()), "_range": pa.array([c.range] * len(cuts), pa.int32()),
                         "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
                         "keys": pa.array([keys[s:e].astype("<u8").tobytes() for _, s, e in cuts], pa.binary())})
    return ask


def match_windows(table: pa.Table) -> pa.Table:
    """The bit of a window is set if a chunk of an earlier range of ids has it."""
    sets = [np.frombuffer(k.as_py(), "<u8") for k in table.column("keys")]
    keys, place, _ = merged(sets)
    range_ = np.repeat(table.column("_range").to_numpy(), list(map(len, sets)))
    first = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(first, place, range_)
    return replies(table, np.cumsum([0, *map(len, sets)]), range_ > first[place], 2)


def remove(bits: int):
    def use(table: pa.Table, replies_: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        c = Chunk(table)
        probes, at, _ = c.probes()
        start, keys, place = c.candidates(C.answers(replies_, 1, probes, bits), at)
        earlier = C.answers(replies_, 2, keys, bits)
        rank = c.rank[c.row[start]]
        low = np.full(len(keys), LAST)
        np.minimum.at(low, place, rank)
        gone = start[earlier[place] | (rank > low[place])]
        cover = np.zeros(len(c.word) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        keep = np.cumsum(cover[:-1]) == 0
        n = np.bincount(c.row, minlength=table.num_rows)
        n_kept = np.bincount(c.row[keep], minlength=table.num_rows)
        # Kept words with a blank behind each, gathered by byte; the last blank of a row is dropped.
        size = (c.end - c.begin)[keep] + 1
        first = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(first, size)
        out = c.body[np.minimum(inside + np.repeat(c.begin[keep], size), len(c.body) - 1)] if len(size) else np.zeros(0, np.uint8)
        out[first + size - 1] = 32
        edge = np.r_[0, np.cumsum(np.bincount(c.row[keep], size, table.num_rows)).astype(np.int64)]
        whole = out.tobytes()
        kept = [whole[s:max(s, e - 1)].decode() for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return pa.table([pa.array(c.ids, pa.int64(), mask=c.null), pa.array(n), pa.array(n - n_kept), pa.array(kept, pa.string())], names)
    return use


def without_repeats(docs: DataFrame, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by one space) of every row."""
    texts, size = C.chunked(docs, chunk_bytes)
    bits = C.bucket_bits(size)  # about one word, and one packed key, per six bytes of text
    blocks = C.asked(texts, PROBES, ask_blocks(bits)).groupBy("bucket").applyInArrow(per_group(match_blocks), C.ANSWER)
    windows = C.told(texts, blocks, WINDOWS, ask_windows(bits)).groupBy("bucket").applyInArrow(per_group(match_windows), C.ANSWER)
    return C.told(texts, blocks.unionByName(windows), "doc_id long, n_words long, n_removed long, kept string", remove(bits))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
