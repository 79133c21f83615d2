"""Suffix-array de-duplication of byte strings by merging Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts elsewhere, in the same document or another.
A transform of all suffixes of a corpus cannot be merged in one place, and most suffixes repeat nothing. So:

1. In every window of ``LENGTH`` bytes the run of ``GRAM`` bytes with the least hash is the window's anchor (equal windows
   have the same anchor at the same offset). Anchors that occur once hold no repeat.
2. Every remaining occurrence is a span: all windows that share the anchor's place. Spans go, once per chunk and content,
   to the bucket of their anchor. The spans of a chunk are a shard: its suffixes are those that begin at anchors, with the
   bytes to the left as the symbols of its transform.
3. A bucket merges its shards: the suffixes behind equal anchors are ordered once, with the common prefixes of
   neighbours. Then the interleave is refined step by step as in transform merging: step i splits each block of the
   merged order by the i-th symbol to the left, which keeps the order inside a block, so suffixes are never sorted again.
   In the block of step i all suffixes share i bytes on the left; two of them are an interval of a repeated string of
   ``LENGTH`` bytes if the least common prefix between them (a range minimum) is at least ``LENGTH`` - i. Blocks of one
   suffix are resolved and leave.

An anchor that occurs more than ``HOT`` times (a line that a third of all documents share) would gather an unbounded number
of spans in one bucket. Its windows are dealt one by one, by a hash of their bytes, so that equal ones meet wherever they
come from and a chunk sends each once; this exact way for the rest needs no order among them.

Texts are shuffled once, into chunks; buckets answer with one bit per window. Defined results: a null text is empty; a
text below ``LENGTH`` bytes is kept whole; repeated rows repeat each other's strings; ids are only passed on; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import chunks as C
from auditloom.llm.common import mixed, per_group

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM + 1
SEGMENT = 1 << 20
#: Average text bytes of a chunk.
CHUNK_BYTES = 3 << 20
#: Spans that are merged at a time, besides the rest of a group.
MERGED = 8192
#: Occurrences above which an anchor's windows are dealt one by one.
HOT = 20_000
ANCHORS = "_chunk int, bucket int, keys binary, counts binary"
WINDOWS = "_chunk int, bucket int, keys binary, several binary"
SPANS = "_chunk int, bucket int, anchors binary, contents binary, left binary, windows binary, several binary, bytes binary"


def gram_hashes(body: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Hash of ``length`` bytes (a power of two) from each place on, by doubling."""
    h, width, step = C.LETTER[body], 1, int(C.STEP)
    while width < length:
        h = h[:-width] * np.uint64(step) + h[width:]
        width, step = 2 * width, (step * step + 2) % 2**64
    return mixed(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n])


@dataclass
class Occurrences:
    """Anchor key and place, first and last window start, of every run of windows with one anchor place."""

    anchor: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def only(self, keep: np.ndarray) -> Occurrences:
        return Occurrences(self.anchor[keep], self.place[keep], self.low[keep], self.high[keep])

    @classmethod
    def of(cls, body: np.ndarray, at: np.ndarray) -> Occurrences:
        size = np.diff(at)
        own = size >= LENGTH
        inside = np.zeros(len(body) + 1, np.int8)
        inside[at[:-1][own]] = 1
        inside[at[1:][own] - LENGTH + 1] -= 1
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        got: list[tuple[np.ndarray, ...]] = []
        for s in range(0, max(0, len(body) - LENGTH + 1), SEGMENT):
            e = min(s + SEGMENT, len(body) - LENGTH + 1)
            start = np.flatnonzero(inside[s:e])
            if not len(start):
                continue
            h = gram_hashes(body[s:e + LENGTH - 1])
            # The place in the low bits makes the first of equal anchors the least one.
            least = sliding_least((h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), REACH)
            place = (least[start] & np.uint64(0xFFFFFF)).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(start) != 1)])
            last = np.r_[edge[1:], len(start)] - 1
            # Least hashes crowd near zero; mixed again, their leading bits deal them evenly over the buckets.
            got.append((mixed(h[place[edge]]), place[edge] + s, start[edge] + s, start[last] + s))
        if not got:
            return cls(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        anchor, place, low, high = (np.concatenate(x) for x in zip(*got))
        new = np.r_[True, (place[1:] != place[:-1]) | (low[1:] != high[:-1] + 1)]  # runs cut by a segment's end
        return cls(anchor[new], place[new], low[new], high[np.r_[np.flatnonzero(new)[1:], len(new)] - 1])

    def contents(self, body: np.ndarray, piece: int = 1 << 19) -> np.ndarray:
        """Hash of each span's bytes, offset and number of windows."""
        size = self.high - self.low + LENGTH
        power = C.powers(int(size.max(initial=1)))
        out = np.empty(len(size), np.uint64)
        part = np.cumsum(size) // piece
        cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(size)]
        for s, e in zip(cut[:-1], cut[1:]):
            if e > s:
                n = size[s:e]
                first = np.cumsum(n) - n
                inside = np.arange(n.sum()) - np.repeat(first, n)
                out[s:e] = np.add.reduceat(C.LETTER[body[inside + np.repeat(self.low[s:e], n)]] * power[inside], first)
        return mixed(out + (self.place - self.low).astype(np.uint64) * C.NEXT + size.astype(np.uint64))


class Chunk:
    """A chunk's texts as one byte array, and the occurrences of its anchors."""

    def __init__(self, table: pa.Table):
        self.number = table.column("_chunk")[0].as_py()
        self.ids = table.column("doc_id")
        self.body, self.at = C.bytes_of(table)
        self.found = Occurrences.of(self.body, self.at)

    def open(self, replies: pa.Table, bits: int) -> tuple[Occurrences, Occurrences]:
        """Occurrences of repeated anchors: those that go as spans, and the hot ones."""
        keys, place = np.unique(self.found.anchor, return_inverse=True)
        if not len(keys):
            return self.found, self.found
        hot = C.answers(replies, 3, keys, bits)
        return self.found.only((C.answers(replies, 1, keys, bits) & ~hot)[place]), self.found.only(hot[place])

    def windows(self, hot: Occurrences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows of hot anchors, the sorted distinct hashes of their bytes, the place among these."""
        n = hot.high - hot.low + 1
        start = np.sort(np.repeat(hot.low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        value = np.empty(len(start), np.uint64)
        half = 128  # two overlapping halves of a window tell all its bytes
        for s in range(0, len(self.body), SEGMENT):
            a, b = np.searchsorted(start, [s, s + SEGMENT])
            if b > a:
                h = gram_hashes(self.body[s:s + SEGMENT + LENGTH], half)
                at = start[a:b] - s
                value[a:b] = mixed(h[at] * C.NEXT + h[at + LENGTH - half])
        keys, place = np.unique(value, return_inverse=True)
        return start, keys, place

    def spans(self, open_: Occurrences) -> tuple[Occurrences, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The occurrences; their distinct (anchor, content), sorted; one of each; the place among these."""
        content = open_.contents(self.body)
        order = np.lexsort((content, open_.anchor))
        a, c = open_.anchor[order], content[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(a) else np.zeros(0, bool)
        at = np.empty(len(a), np.int64)
        at[order] = np.cumsum(new) - 1
        return open_, a[new], c[new], order[new], at


def ask_anchors(bits: int):
    def ask(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        keys, n = np.unique(c.found.anchor, return_counts=True)
        cuts = C.dealt(keys, bits)
        low = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        return pa.table({"_chunk": pa.array([c.number] * len(cuts), pa.int32()), "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
                         "keys": pa.array([low[s:e].tobytes() for _, s, e in cuts], pa.binary()),
                         "counts": pa.array([np.minimum(n[s:e], 65_535).astype("<u2").tobytes() for _, s, e in cuts], pa.binary())})
    return ask


def answer(table: pa.Table, which: int, at: np.ndarray, bit: np.ndarray) -> pa.Table:
    """The bits from at[k] to at[k + 1] for the k-th question; questions without a set bit get no answer."""
    rows = [k for k in range(table.num_rows) if bit[at[k]:at[k + 1]].any()]
    chunk, bucket = table.column("_chunk").to_pylist(), table.column("bucket").to_pylist()
    return pa.table({"_chunk": pa.array([chunk[k] for k in rows], pa.int32()), "bucket": pa.array([bucket[k] for k in rows], pa.int32()),
                     "round": pa.array([which] * len(rows), pa.int32()),
                     "bits": pa.array([C.packed(bit[at[k]:at[k + 1]]) for k in rows], pa.binary())})


def match_anchors(hot: int):
    """Round 1: anchors that occur twice, in one chunk or several. Round 3: those that occur too often for spans."""
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(k.as_py(), "<u4") for k in table.column("keys")]
        keys, place = np.unique(np.concatenate(sets), return_inverse=True)
        n = np.bincount(place, np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("counts")]), len(keys))
        at = np.cumsum([0, *map(len, sets)])
        return pa.concat_tables([answer(table, 1, at, (n > 1)[place]), answer(table, 3, at, (n > hot)[place])])
    return run


def ask_windows(bits: int):
    def ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = [f.split(" ")[0] for f in WINDOWS.split(", ")]
        if not table.num_rows or not replies.num_rows or 3 not in replies.column("round").to_pylist():
            return pa.table([pa.array([], k) for k in (pa.int32(), pa.int32(), pa.binary(), pa.binary())], names)
        c = Chunk(table)
        _, keys, place = c.windows(c.open(replies, bits)[1])
        several = np.bincount(place, minlength=len(keys)) > 1
        cuts = C.dealt(keys, bits)
        return pa.table([pa.array([c.number] * len(cuts), pa.int32()), pa.array([b for b, _, _ in cuts], pa.int32()),
                         pa.array([keys[s:e].astype("<u8").tobytes() for _, s, e in cuts], pa.binary()),
                         pa.array([C.packed(several[s:e]) for _, s, e in cuts], pa.binary())], names)
    return ask


def match_windows(table: pa.Table) -> pa.Table:
    """Windows of hot anchors that occur twice."""
    sets = [np.frombuffer(k.as_py(), "<u8") for k in table.column("keys")]
    keys, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.concatenate([C.unpacked(x.as_py(), len(s)) for x, s in zip(table.column("several"), sets)])
    good = (n > 1) | (np.bincount(place, several, len(keys)) > 0)
    return answer(table, 4, np.cumsum([0, *map(len, sets)]), good[place])


def ask_spans(bits: int):
    def ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n in ("_chunk", "bucket") else pa.binary())
                             for n in (f.split(" ")[0] for f in SPANS.split(", "))})
        c = Chunk(table)
        open_, anchor, content, first, at = c.spans(c.open(replies, bits)[0])
        own = open_.only(first)
        left, windows = own.place - own.low, own.high - own.low + 1
        several = np.bincount(at, minlength=len(anchor)) > 1
        cuts = C.dealt(anchor, bits)
        tool = zstandard.ZstdCompressor(level=1)

        def body(s: int, e: int) -> bytes:
            return tool.compress(b"".join(c.body[x:y].tobytes() for x, y in zip(own.low[s:e].tolist(), (own.high[s:e] + LENGTH).tolist())))

        def column(x: np.ndarray, kind: str) -> pa.Array:
            return pa.array([x[s:e].astype(kind).tobytes() for _, s, e in cuts], pa.binary())

        return pa.table({"_chunk": pa.array([c.number] * len(cuts), pa.int32()), "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
                         "anchors": column(anchor, "<u8"), "contents": column(content, "<u8"), "left": column(left, "<u2"),
                         "windows": column(windows, "<u2"), "several": pa.array([C.packed(several[s:e]) for _, s, e in cuts], pa.binary()),
                         "bytes": pa.array([body(s, e) for _, s, e in cuts], pa.binary())})
    return ask


class LeastCommon:
    """Range minima of the common prefixes of neighbours in an order."""

    def __init__(self, lcp: np.ndarray):
        self.levels = [lcp]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at places a < b; lcp[k] belongs to the places k and k + 1."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.levels[k][a[m]], self.levels[k][b[m] - (1 << k)])
        return out


def repeated(group: np.ndarray, text: np.ndarray, start: np.ndarray, left: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For spans of different content: [span, i] is true if the window that starts i bytes left of the anchor occurs in
    another span of the same anchor. ``text``: all bytes; ``start``, ``left``, ``windows``: where a span's bytes begin, the
    bytes left of the anchor and the number of windows."""
    n = len(group)
    flag = np.zeros((n, REACH), bool)
    if n < 2:
        return flag
    least = left - windows + 1  # windows start from ``least`` to ``left`` bytes left of the anchor
    right = np.minimum(LENGTH - least, LENGTH)
    inside = np.arange(LENGTH)
    place = (start + left)[:, None] + inside
    suffix = np.where(inside < right[:, None], text[np.minimum(place, len(text) - 1)], 0).astype(np.uint8)
    words = suffix.view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group))
    differs = suffix[order[1:]] != suffix[order[:-1]]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    lcp[group[order[1:]] != group[order[:-1]]] = 0
    common = LeastCommon(lcp.astype(np.uint8))
    group, start, left, least = group[order], start[order], left[order], least[order]
    rank, block = np.arange(n), np.cumsum(np.r_[0, group[1:] != group[:-1]])
    for i in range(REACH):
        valid = np.flatnonzero(least[rank] <= i)
        r, b = rank[valid], block[valid]
        near = np.flatnonzero(b[1:] == b[:-1])
        hit = near[common.between(r[near], r[near + 1]) >= LENGTH - i]
        flag[order[r[hit]], i] = flag[order[r[hit + 1]], i] = True
        go = left[rank] > i
        rank, block = rank[go], block[go]
        # The next symbol to the left splits the blocks; inside a block the order stays.
        symbol = text[start[rank] + left[rank] - i - 1].astype(np.int64)
        key = block * 256 + symbol
        turn = np.argsort(key, kind="stable")
        key, rank = key[turn], rank[turn]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        block = np.cumsum(new) - 1
        shared = np.bincount(block, minlength=1)[block] > 1 if len(key) else new
        rank, block = rank[shared], block[shared]
        if not len(rank):
            break
    return flag


def match_spans(table: pa.Table) -> pa.Table:
    """One bit per window of every asked span: whether it occurs twice."""
    def column(name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

    anchor, content = column("anchors", "<u8"), column("contents", "<u8")
    left, windows = column("left", "<u2").astype(np.int64), column("windows", "<u2").astype(np.int64)
    count = [len(x.as_py()) // 8 for x in table.column("anchors")]
    several = np.concatenate([C.unpacked(x.as_py(), n) for x, n in zip(table.column("several"), count)])
    text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) for x in table.column("bytes")), np.uint8)
    size = windows + LENGTH - 1
    start = np.cumsum(size) - size
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    kind = np.empty(len(a), np.int64)
    kind[order] = np.cumsum(new) - 1
    one = order[new]  # a span of every kind
    times = np.bincount(kind, 1 + several, len(one))
    group = np.cumsum(np.r_[0, anchor[one][1:] != anchor[one][:-1]])
    alone = np.bincount(group)[group] == 1
    open_ = np.bincount(group, times == 1)[group] > 0
    bit_at = np.cumsum(windows[one]) - windows[one]
    bit = np.repeat(times > 1, windows[one])
    which = np.flatnonzero(~alone & open_)
    # Whole groups of equal anchors at a time, so that what a step holds does not grow with the bucket.
    first = np.flatnonzero(np.r_[True, group[which][1:] != group[which][:-1]]) if len(which) else np.zeros(0, np.int64)
    part = first[np.r_[True, np.diff(first // MERGED) > 0]] if len(first) else first
    for s, e in zip(part, [*part[1:], len(which)]):
        some = which[s:e]
        n, own = windows[one[some]], left[one[some]]
        flag = repeated(group[some], text, start[one[some]], own, n)
        k = np.repeat(np.arange(len(some)), n)
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bit[np.repeat(bit_at[some], n) + w] |= flag[k, np.repeat(own, n) - w]
    edge = np.r_[0, np.cumsum(count)]
    every = np.empty(windows.sum(), bool)
    to = np.r_[0, np.cumsum(windows)]
    for s, e in zip(edge[:-1], edge[1:]):
        n = windows[s:e]
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        every[to[s]:to[e]] = bit[np.repeat(bit_at[kind[s:e]], n) + w]
    return answer(table, 2, to[edge], every)


def remove(bits: int, passed_on: int = 0):
    """Rows without the repeated bytes. With columns passed on, ``kept`` loses the parts of cut letters as well."""
    def use(table: pa.Table, replies: pa.Table) -> pa.Table:
        more = [f"_p{k}" for k in range(passed_on)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *more]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if more else pa.binary()]
        if not table.num_rows:
            return pa.table([*(pa.array([], k) for k in kinds), *(table.column(c) for c in more)], names)
        c = Chunk(table)
        open_, hot = c.open(replies, bits)
        open_, anchor, _, first, at = c.spans(open_)
        windows = (open_.high - open_.low + 1)[first]
        bit_at = np.cumsum(windows) - windows
        bit = np.zeros(windows.sum(), bool)
        got = {b: data for b, r, data in zip(*(replies.column(x).to_pylist() for x in ("bucket", "round", "bits"))) if r == 2}
        for b, s, e in C.dealt(anchor, bits):
            if b in got:
                n = int(windows[s:e].sum())
                bit[bit_at[s]:bit_at[s] + n] = C.unpacked(got[b], n)
        n = open_.high - open_.low + 1
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = (np.repeat(open_.low, n) + w)[bit[np.repeat(bit_at[at], n) + w]]
        if len(hot.anchor):
            often, keys, place = c.windows(hot)
            start = np.r_[start, often[C.answers(replies, 4, keys, bits)[place]]]
        cover = np.zeros(len(c.body) + 1, np.int32)
        np.add.at(cover, start, 1)
        np.subtract.at(cover, start + LENGTH, 1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        size = np.diff(c.at)
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        text_start = c.at[:-1][size > 0]
        begin[text_start] = gone[text_start]
        n_gone, spans = (np.diff(np.r_[0, np.cumsum(x, dtype=np.int32)][c.at]).astype(np.int64) for x in (gone, begin))
        kept = c.body[~gone].tobytes()
        edge = np.r_[0, np.cumsum(size - n_gone)].tolist()
        rows = [kept[s:e] for s, e in zip(edge[:-1], edge[1:])]
        text = pa.array([x.decode("utf-8", "ignore") for x in rows], pa.string()) if more else pa.array(rows, pa.binary())
        return pa.table([c.ids.combine_chunks(), pa.array(size), pa.array(n_gone), pa.array(spans), text, *(table.column(x) for x in more)], names)
    return use


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, passed_on: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row.

    With columns to be passed on, ``kept`` is a text, and these columns follow as ``_p0``, ``_p1``, ...
    """
    texts, size = C.chunked(docs, chunk_bytes, passed_on)
    bits = C.bucket_bits(2 * size)
    anchors = C.asked(texts, ANCHORS, ask_anchors(bits)).groupBy("bucket").applyInArrow(per_group(match_anchors(hot)), C.ANSWER)
    spans = C.told(texts, anchors, SPANS, ask_spans(bits)).groupBy("bucket").applyInArrow(per_group(match_spans), C.ANSWER)
    windows = C.told(texts, anchors, WINDOWS, ask_windows(bits)).groupBy("bucket").applyInArrow(per_group(match_windows), C.ANSWER)
    schema = KEPT
    if passed_on:
        more = ", ".join(f"_p{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(passed_on))
        schema = f"{KEPT.replace('kept binary', 'kept string')}, {more}"
    return C.told(texts, anchors.unionByName(spans).unionByName(windows), schema, remove(bits, len(passed_on or [])))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, ``text`` without repeated bytes and, if there is one, ``n_chars`` set anew.

    Nothing is removed from a text without repeats, which stays as it is, null included.
    """
    rows = without_repeats(docs, passed_on=docs.columns)
    old = {c: F.col(f"_p{k}") for k, c in enumerate(docs.columns)}
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(old["text"])
    new = old | {"text": text}
    if "n_chars" in old:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    return rows.select(*[v.alias(c) for c, v in new.items()])
