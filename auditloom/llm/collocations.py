"""Phrase collocations by dynamic itemset counting.

The documents are written in shards, and the shards are scanned in a cycle. A scan counts the phrases that are active in it:
words from the first scan on, a longer phrase from the scan after both of its subphrases (without the last word, without the
first) have been counted often enough, whatever lengths these are then being counted for. Every phrase stays active for
one full cycle, so its count is exact, and scanning ends when no phrase is active any more.

Which scan found a phrase frequent is kept in a table of 2^n cells, by leading bits of the phrase's 64-bit key; tasks read
from it when a phrase starts. Cells that phrases share only make more candidates, never fewer, and all candidates are
counted exactly. The table has a fixed size however many phrases there are; it is the only thing that is broadcast.

A task counts the phrases of its rows (bounded pieces, merged before they leave) and deals sorted keys with counts to key
buckets, packed. A bucket adds them to its open counts, keeps complete frequent phrases and carries the open ones on to the
next scan. A frequent word pair is one entry per task. When all are complete, the words of frequent phrases are read in parts of
rising size, each only for phrases that the parts before did not have, so that common phrases do not come from every task. Cuts,
scores and ranks are joins and aggregates on phrases.

Defined results: a null text has no words, a null language is ``und``; counts are over all rows, repeated ones too; no
document id is needed; other columns are not read; an empty table, or one without frequent phrases, gives no rows. Phrases are
told apart by 64-bit keys of language and words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.cut import written
from auditloom.functions.joins import measured
from auditloom.llm import chunks as C
from auditloom.llm.common import flat, mixed, per_group, per_pair, slices
from auditloom.session import checkpoint_dir

LENGTHS, LEAST, SHARE, FACTOR, FIRST = 4, 30, 80, 2_000_000, 2000
#: Scans of a full cycle, leading key bits of the table of cells (one byte a cell).
SHARDS, CELL_BITS = 3, 24
#: Text bytes counted at a time, counted phrases that a task holds before it sends them, average bytes of text per bucket.
SLICE, HELD, BUCKET_TEXT = 4 << 20, 3_000_000, 16 << 20
#: Of every 32 tasks that write the shards, the first of those whose rows are in part 0, 1 and 2.
PARTS = (0, 1, 8)
#: Places of a task's memory of keys that it has told.
TOLD = 1 << 21
#: Parts that are ranked on their own before the best of each meet.
RANK_PARTS = 64
COUNTS = "bucket int, length int, start int, keys binary, counts binary"
SPACE, BORDER = 1, 2
GAP = re.compile(r"[ \t]+")
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BORDER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of some rows: keys, pieces and bytes."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        body, self.at = flat(text)
        self.body = LOWER[body]
        kind = KIND[self.body]
        self.key, self.row, self.begin, self.end = C.words(np.where(kind == BORDER, np.uint8(0x20), self.body), self.at)
        self.langs, place = np.unique(np.array(lang.fill_null("und").to_pylist(), object).astype(str), return_inverse=True)
        seed = np.array([_key_of(x) for x in self.langs], np.uint64)
        self.lang = place[self.row]
        self.key = mixed(self.key ^ seed[self.lang]) if len(seed) else self.key
        # Words of one piece: no border between them, and the same row.
        self.piece = np.cumsum(kind == BORDER)[self.begin] + self.row

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, 64-bit keys of the phrases from each word on, and whether they lie in one piece."""
        h = np.zeros(len(self.key), np.uint64)
        for n in range(1, LENGTHS + 1):
            m = max(0, len(self.key) - n + 1)
            h = h[:m] * C.STEP + self.key[n - 1:]
            yield n, mixed(h + np.uint64(n * int(C.NEXT) % 2**64)), self.piece[:m] == self.piece[n - 1:n - 1 + m]


def _key_of(lang: str) -> int:
    value = 0xCBF29CE484222325
    for b in lang.encode():
        value = (value ^ b) * 0x100000001B3 % 2**64
    return value


def cell(keys: np.ndarray, cell_bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - cell_bits)).astype(np.int64)


def active(words: Words, cells: np.ndarray, step: int, shards: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Length, first scan and keys of the occurrences that the scan ``step`` counts."""
    ready, cell_bits = None, len(cells).bit_length() - 1
    for n, keys, whole in words.phrases():
        if n == 1:
            start = np.ones(len(keys), np.uint8)
        else:
            start = np.where((ready[:-1] > 0) & (ready[1:] > 0) & whole, np.maximum(ready[:-1], ready[1:]), 0).astype(np.uint8)
        for s in range(max(1, step - shards + 1), step + 1):
            chosen = keys[start == s]
            if len(chosen):
                yield n, s, chosen
        if n < LENGTHS:
            # A shared cell may be older than the phrase's own start; what builds on the phrase cannot be.
            found = cells[cell(keys, cell_bits)]
            ready = np.where((start > 0) & (found > 0), np.maximum(found + 1, start), 0)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes: the planes of high bytes, nearly all zero, take no room when compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def count_rows(length: int, start: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[dict]:
    return [{"bucket": b, "length": length, "start": start, "keys": pack_keys(keys[i:j]), "counts": pack(counts[i:j])} for b, i, j in C.dealt(keys, bits)]


COUNT_TYPES = pa.schema([("bucket", pa.int32()), ("length", pa.int32()), ("start", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
MERGE_TYPES = pa.schema([("kind", pa.string()), *COUNT_TYPES])
PHRASE_TYPES = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()),
                          ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])


def scan(shard: DataFrame, cells: Broadcast, step: int, shards: int, bits: int, most: int = HELD) -> DataFrame:
    """Counts of the phrases that are active in this scan, by bucket, from each task's rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (n, s), (keys, counts) in held.items():
                yield pa.RecordBatch.from_pylist(count_rows(n, s, *added(keys, counts), bits), COUNT_TYPES)
            held.clear()

        for b in slices(batches, "text", SLICE):
            words = Words(b.column("text"), b.column("lang"))
            for n, s, keys in active(words, cells.value, step, shards):
                keys, counts = np.unique(keys, return_counts=True)
                ours = held.setdefault((n, s), ([], []))
                ours[0].append(keys)
                ours[1].append(counts.astype(np.int64))
                size += len(keys)
            if size > most:
                for of, (keys, counts) in held.items():
                    one = added(keys, counts)
                    held[of] = ([one[0]], [one[1]])
                size = sum(len(k) for keys, _ in held.values() for k in keys)
                if size > most // 2:
                    yield from sent()
                    size = 0
        yield from sent()
    return shard.mapInArrow(count, COUNTS)


def merged(counts: DataFrame, step: int, shards: int, least: int, bits: int, cell_bits: int) -> DataFrame:
    """Sums per bucket: ``open`` counts, ``done`` frequent phrases, and as ``cells`` the bits of cells with frequent ones.

    The bits are those of phrases that longer ones may build on (length 1), and of the longest phrases.
    """

    def merge(table: pa.Table) -> pa.Table:
        bucket, rows = table.column("bucket")[0].as_py(), []
        seen = {n: np.zeros(1 << (cell_bits - bits), bool) for n in (1, LENGTHS)}
        length, start = (table.column(c).to_numpy() for c in ("length", "start"))
        for n, s in sorted(set(zip(length.tolist(), start.tolist()))):
            own = np.flatnonzero((length == n) & (start == s))
            keys, total = added([unpack_keys(table.column("keys")[int(i)].as_py()) for i in own],
                                [unpack(table.column("counts")[int(i)].as_py()).astype(np.int64) for i in own])
            often = total >= least
            seen[LENGTHS if n == LENGTHS else 1][cell(keys[often], cell_bits) & ((1 << (cell_bits - bits)) - 1)] = True
            complete = s + shards - 1 <= step
            kept = often if complete else np.ones(len(keys), bool)
            if kept.any():
                rows.append({"kind": "done" if complete else "open", "bucket": bucket, "length": n, "start": s,
                             "keys": pack_keys(keys[kept]), "counts": pack(total[kept])})
        rows += [{"kind": "cells", "bucket": bucket, "length": n, "start": step, "keys": C.packed(bit), "counts": None} for n, bit in seen.items() if bit.any()]
        return pa.Table.from_pylist(rows, MERGE_TYPES)
    return counts.groupBy("bucket").applyInArrow(per_group(merge), "kind string, " + COUNTS)


def witnesses(rows: DataFrame, cells: Broadcast, bits: int) -> DataFrame:
    """Words of the phrases whose cell is set, about once per task and phrase; rows of length 0 are word counts of languages."""
    schema = pa.schema([("bucket", pa.int32()), ("length", pa.int32()), ("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        cell_bits = len(cells.value).bit_length() - 1
        told = np.zeros(TOLD, np.uint64)  # by low bits; a phrase told twice does no harm
        for b in slices(batches, "text", SLICE):
            words = Words(b.column("text"), b.column("lang"))
            for lang, n in zip(words.langs.tolist(), np.bincount(words.lang, minlength=len(words.langs)).tolist()):
                total[lang] = total.get(lang, 0) + n
            for n, keys, whole in words.phrases():
                at = np.flatnonzero(whole & cells.value[cell(keys, cell_bits)])
                one, first = np.unique(keys[at], return_index=True)
                new = told[one & np.uint64(TOLD - 1)] != one
                one, at = one[new], at[first[new]]
                told[one & np.uint64(TOLD - 1)] = one
                phrase = [GAP.sub(" ", words.body[i:j].tobytes().decode()) for i, j in zip(words.begin[at].tolist(), words.end[at + n - 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array((one >> np.uint64(64 - bits)).astype(np.int32)), pa.array(np.full(len(one), n, np.int32)),
                                                  pa.array(one.view(np.int64)), pa.array(words.langs[words.lang[at]].tolist(), pa.string()),
                                                  pa.array(phrase, pa.string()), pa.nulls(len(one), pa.int64())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"bucket": -1 - _key_of(x) % 1024, "length": 0, "lang": x, "n": n} for x, n in total.items()], schema)
    return rows.mapInArrow(read, "bucket int, length int, key long, lang string, phrase string, n long")


def named(done: DataFrame, read: DataFrame, bits: int, cell_bits: int) -> DataFrame:
    """lang, length, phrase, f of frequent phrases; rows of length 0 hold word counts of languages, and rows of length -1 the
    counts that are still without words, with the bits of their cells."""
    width = 1 << (cell_bits - bits)

    def match(counted: pa.Table, told: pa.Table) -> pa.Table:
        lang, length, phrase, key = (told.column(c) for c in ("lang", "length", "phrase", "key"))
        if told.num_rows and told.column("bucket")[0].as_py() < 0:
            total = told.group_by("lang").aggregate([("n", "sum")])
            return pa.Table.from_pylist([{"lang": x, "length": 0, "f": n} for x, n in zip(total.column("lang").to_pylist(), total.column("n_sum").to_pylist())], PHRASE_TYPES)
        rows = counted.num_rows
        keys, f = added([unpack_keys(counted.column("keys")[i].as_py()) for i in range(rows)] or [np.zeros(0, np.uint64)],
                        [unpack(counted.column("counts")[i].as_py()).astype(np.int64) for i in range(rows)] or [np.zeros(0, np.int64)])
        asked, first = np.unique(key.to_numpy().view(np.uint64), return_index=True) if told.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hit = np.isin(asked, keys, assume_unique=True)
        at = pa.array(first[hit])
        out = pa.table([lang.take(at), length.take(at), phrase.take(at), pa.array(f[np.searchsorted(keys, asked[hit])]),
                        *(pa.nulls(len(at), PHRASE_TYPES.field(c).type) for c in ("bucket", "keys", "counts", "bits"))], schema=PHRASE_TYPES)
        rest = ~np.isin(keys, asked[hit], assume_unique=True)
        if not rest.any():
            return out
        bit = np.zeros(width, bool)
        bit[cell(keys[rest], cell_bits) & (width - 1)] = True
        return pa.concat_tables([out, pa.Table.from_pylist([{"length": -1, "bucket": counted.column("bucket")[0].as_py(), "keys": pack_keys(keys[rest]),
                                                             "counts": pack(f[rest]), "bits": C.packed(bit)}], PHRASE_TYPES)])
    return done.groupBy("bucket").cogroup(read.groupBy("bucket")).applyInArrow(
        per_pair(match), "lang string, length int, phrase string, f long, bucket int, keys binary, counts binary, bits binary")


def set_bits(rows: DataFrame, name: str, cell_bits: int, bits: int) -> np.ndarray:
    """The cells that rows of (bucket, bits) set: one bit per cell comes to the driver."""
    out, width = np.zeros(1 << cell_bits, bool), 1 << (cell_bits - bits)
    for r in rows.select("bucket", name).toLocalIterator():
        out[r["bucket"] * width:(r["bucket"] + 1) * width] |= C.unpacked(bytes(r[name]), width)
    return out


def in_shards(docs: DataFrame, shards: int) -> DataFrame:
    """lang, text, shard and part, written by these; repeated rows spread over all shards."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    task = F.spark_partition_id() % 32
    docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
                F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
                F.when(task < PARTS[1], 0).when(task < PARTS[2], 1).otherwise(2).alias("part")).write.partitionBy("shard", "part").parquet(path)
    return spark.read.schema("lang string, text string, shard int, part int").parquet(path)


def frequent(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, cell_bits: int = CELL_BITS, held: int = HELD) -> DataFrame:
    """lang, length, phrase, f of all phrases of up to four words with f >= least, and word counts as rows of length 0."""
    spark = docs.sparkSession
    rows = in_shards(docs, shards)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = min(cell_bits - 3, max(4, int(np.ceil(np.log2(max(1, size / BUCKET_TEXT))))))
    cells, often = np.zeros(1 << cell_bits, np.uint8), np.zeros(1 << cell_bits, bool)
    done, carried, step, last = [], None, 0, 0
    while step < max(shards, last + shards):
        step += 1
        known = spark.sparkContext.broadcast(cells)
        counts = scan(rows.where(F.col("shard") == (step - 1) % shards).select("lang", "text"), known, step, shards, bits, held)
        out = written(merged(counts if carried is None else counts.unionByName(carried), step, shards, least, bits, cell_bits))
        known.destroy()
        done.append(out.where("kind = 'done'").select("bucket", "keys", "counts"))
        carried = out.where("kind = 'open'").drop("kind")
        marks = out.where("kind = 'cells'")
        found = set_bits(marks.where(F.col("length") < LENGTHS), "keys", cell_bits, bits)
        often |= found | set_bits(marks.where(F.col("length") == LENGTHS), "keys", cell_bits, bits)
        if (new := found & (cells == 0)).any():
            cells, last = np.where(new, np.uint8(step), cells), step
    asked = done[0]
    for d in done[1:]:
        asked = asked.unionByName(d)
    names = None
    for part in range(len(PARTS)):
        shared = spark.sparkContext.broadcast(often)
        out = written(named(asked, witnesses(rows.where(F.col("part") == part).select("lang", "text"), shared, bits), bits, cell_bits))
        shared.destroy()
        told = out.where("length >= 0").select("lang", "length", "phrase", "f")
        names = told if names is None else names.unionByName(told)
        asked = out.where("length = -1").select("bucket", "keys", "counts")
        often = set_bits(out.where("length = -1"), "bits", cell_bits, bits)
    if often.any():
        raise RuntimeError("the words of a counted phrase were not found again: the shards have changed")
    return names


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, first: int = FIRST, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    A phrase scores by its weakest cut, and gives way to a longer phrase that has ``share`` percent of its occurrences.
    """
    known = frequent(docs, least, shards)
    total = known.where("length = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    counted = measured(known.where("length > 0").select("lang", "phrase", "f"))
    long_ = known.where("length > 1").select("lang", "length", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("length") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inside = long_.where("length > 2").select("lang", F.explode(part).alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(
        F.max("_longer").alias("_longer"))
    kept = long_.join(measured(inside), ["lang", "phrase"], "left").where(
        F.expr(f"_longer is null or 100 * cast(_longer as decimal(19,0)) < {share} * cast(a as decimal(19,0))")).drop("_longer")
    cuts = kept.select("lang", "phrase", "a", "w", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("_rest"))
    both = cuts.join(counted.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"]).join(
        counted.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    score = F.expr(f"(cast({FACTOR} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select(
        "lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    # At most ``first`` rows of each part of a language meet in the last ranking.
    best = scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(measured(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, {LENGTHS} + 1)) AS size FROM w),
i AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s WHERE len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= {LEAST}),
b AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM (
  SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM c WHERE size > 2)) GROUP BY 1, 2),
k AS (SELECT c.*, unnest(range(1, size)) AS k FROM c LEFT JOIN b USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a),
z AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, CAST((CAST({FACTOR} AS HUGEINT) * k.a) // (l.f + r.f) AS BIGINT) AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
m AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m JOIN t USING (lang)
QUALIFY rank <= {FIRST}"""
