"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every passage of every text is a query. An item's score is divided by the item's score for its own words, so that one
threshold holds for all items. The index keeps the largest impact of a word over all items and over each block of
items: a passage whose summed bounds stay below the threshold is passed over whole, then block by block; the items of
the blocks that remain are scored exactly, and all at or above the threshold are verified: the five-word runs of the
question and of the answer (the last sentence) are looked for in the passage.

The index holds at most ``SHARD_ITEMS`` items and ``SHARD_BYTES`` of text at a time and is broadcast; a larger benchmark
is dealt out over several shards, each of which is searched with all texts. Document frequencies, the mean length and the width of
passages are those of all items, told by one word rule, so results do not depend on the number of shards. Repeated items
are one entry with a count. Bounds are kept for the blocks in which a word occurs, not for all blocks.

Defined results: items and texts without words (null, empty) match nothing; repeated items or documents give repeated
findings; among passages of one text the best, then the first, is reported; columns other than doc_id, text, item_id are
not read by the search; an empty table finds nothing. Passages are twice as long as the longest item and overlap by half,
so every item lies whole in some passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import slices, texts, unused

K1, B = 1.2, 0.75
SHARD_ITEMS, SHARD_BYTES = 4000, 4 << 20
#: Share of an item's own score that a passage must reach, and the shares of five-word runs that verify it.
LEAST_SCORE, LEAST_OVERLAP = 0.6, 0.8
RUN = 5
WORDS = re.compile(r"\w+")
FOUND = "item long, passage long, score double, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer; an item of one sentence is both."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if WORDS.search(s)]
    if len(sentences) < 2:
        return words_of(text), words_of(text)
    return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])


def runs(words: list) -> set[tuple]:
    return {tuple(words[k:k + RUN]) for k in range(max(1, len(words) - RUN + 1))} if words else set()


def spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the spans, and the span that each belongs to."""
    n = stop - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + start[owner], owner


@dataclass
class Index:
    """Inverted index of one shard. Postings of a (word, block) pair lie together."""

    vocab: dict[str, int]
    item_ids: list[int]
    copies: list[int]
    question: list[set[tuple]]
    answer: list[set[tuple]]
    every: list[set[tuple]]
    width: int
    per_block: int
    post_item: np.ndarray
    post_impact: np.ndarray
    pair_at: np.ndarray      # [word] -> first (word, block) pair; unknown words, the last row, have none
    pair_block: np.ndarray
    pair_max: np.ndarray
    pair_post: np.ndarray    # [pair] -> first posting; one more place at the end
    blocks: int
    word_max: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str, int]], df: dict[str, int], n_items: int, mean_length: float, width: int) -> Index:
        words = [words_of(t) for _, t, _ in items]
        vocab = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
        per_block = max(16, -(-len(items) // 64))
        blocks = max(1, -(-len(items) // per_block))
        rows = []
        for k, own in enumerate(words):
            impact = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1)
                      / (n + K1 * (1 - B + B * len(own) / mean_length)) for w, n in Counter(own).items()}
            total = sum(impact.values())
            rows += [(vocab[w] * blocks + k // per_block, k, x / total) for w, x in impact.items()]
        rows.sort()
        key = np.array([r[0] for r in rows], np.int64)
        impact = np.array([r[2] for r in rows], np.float32)
        pair, first = np.unique(key, return_index=True)
        pair_max = np.maximum.reduceat(impact, first) if len(key) else impact
        pair_at = np.searchsorted(pair, np.r_[np.arange(len(vocab) + 1) * blocks, len(vocab) * blocks])
        word_max = np.zeros(len(vocab) + 1, np.float32)
        np.maximum.at(word_max, pair // blocks, pair_max)
        qa = [parts(t) for _, t, _ in items]
        coded = lambda own: [vocab[w] for w in own]
        return cls(vocab, [i for i, _, _ in items], [n for _, _, n in items], [runs(coded(q)) for q, _ in qa], [runs(coded(a)) for _, a in qa],
                   [runs(coded(own)) for own in words], width, per_block, np.array([r[1] for r in rows], np.int64), impact,
                   pair_at, pair % blocks, pair_max, np.r_[first, len(key)], blocks, word_max)

    def search(self, rows: list[str]) -> list[list[tuple[int, int, float, float, float]]]:
        """Per text: item, first word of the passage, score, shares of the question's and of the answer's runs."""
        found: list[dict[int, tuple]] = [{} for _ in rows]
        get, none = self.vocab.get, len(self.vocab)
        own = [np.fromiter(map(get, w, repeat(none)), np.int64, len(w)) for w in map(words_of, rows)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        word = np.concatenate(own) if own else np.zeros(0, np.int64)
        at = np.cumsum(size) - size
        stride = self.width // 2
        n = np.where(size == 0, 0, np.maximum(1, -(-(size - self.width) // stride) + 1))
        doc = np.repeat(np.arange(len(rows)), n)
        begin = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride
        end = np.minimum(begin + self.width, (at + size)[doc])
        bound = np.cumsum(np.r_[0.0, self.word_max[word]])
        keep = np.flatnonzero(bound[end] - bound[begin] >= LEAST_SCORE - 1e-6)
        if not len(keep):
            return [[] for _ in rows]
        begin, end, doc = begin[keep], end[keep], doc[keep]
        # Distinct known words of each remaining passage, then its bound in each block.
        length = end - begin
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
        key = np.repeat(np.arange(len(begin)), length) * (none + 1) + word[place]
        key = np.sort(key[word[place] != none])
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        passage, term = key // (none + 1), key % (none + 1)
        if not len(passage):
            return [[] for _ in rows]
        edge = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        nth = np.cumsum(np.r_[0, passage[1:] != passage[:-1]])
        pairs, owner = spans(self.pair_at[term], self.pair_at[term + 1])
        cell = nth[owner] * self.blocks + self.pair_block[pairs]
        opened = np.bincount(cell, self.pair_max[pairs], (nth[-1] + 1) * self.blocks) >= LEAST_SCORE - 1e-5
        rank = np.cumsum(opened) - 1
        row, block = np.divmod(np.flatnonzero(opened), self.blocks)
        pairs, cell = pairs[opened[cell]], rank[cell[opened[cell]]]
        post, owner = spans(self.pair_post[pairs], self.pair_post[pairs + 1])
        pair = cell[owner]
        total = np.bincount(pair * self.per_block + self.post_item[post] % self.per_block, self.post_impact[post], len(row) * self.per_block)
        for x in np.flatnonzero(total >= LEAST_SCORE - 1e-6).tolist():
            k = x // self.per_block
            item = int(block[k]) * self.per_block + x % self.per_block
            p = int(passage[edge[row[k]]])
            d, s = int(doc[p]), float(total[x])
            if item in found[d] and found[d][item][2] >= s:
                continue
            seen = runs(word[begin[p]:end[p]].tolist())
            short = [{tuple(w) for w in zip(*(word[begin[p] + j:end[p]].tolist() for j in range(m)))} if m < RUN else seen
                     for m in (len(next(iter(self.question[item]))), len(next(iter(self.answer[item]))))]
            q, a = (len(want & have) / len(want) for want, have in zip((self.question[item], self.answer[item]), short))
            whole = len(self.every[item] & seen) / len(self.every[item])
            if min(q, a) >= LEAST_OVERLAP or (whole >= LEAST_OVERLAP and len(next(iter(self.every[item]))) == RUN):
                found[d][item] = (self.item_ids[item], int(begin[p] - at[d]), s, q, a)
        return [sorted((r for item, r in f.items() for _ in range(self.copies[item])), key=lambda r: (r[0] is None, r[0] or 0, r[1])) for f in found]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The index of each shard, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    # Sums over items with words. Copies count as items, but are kept once.
    total = measures(items).where("words > 0").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("copies").alias("n"), F.sum("bytes").alias("b"),
        F.sum(F.col("words") * F.col("copies")).alias("w"), F.max("words").alias("longest")).first()
    if not total["kept"]:
        return
    shards = max(1, -(-total["kept"] // SHARD_ITEMS), -(-total["b"] // SHARD_BYTES))
    dealt = items.withColumn("_shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    for k in range(shards):
        rows = [(r["item_id"], r["text"], r["copies"]) for r in dealt.where(F.col("_shard") == k).orderBy("item_id", "text").collect() if words_of(r["text"])]
        if not rows:
            continue
        if shards == 1:
            counts = Counter()
            for _, t, n in rows:
                counts.update(dict.fromkeys(words_of(t), n))
        else:
            counts = frequencies(items, rows)
        yield Index.build(rows, counts, total["n"], total["w"] / total["n"], max(32, 2 * total["longest"]))


def measures(items: DataFrame) -> DataFrame:
    """copies, bytes and words of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("copies"), pa.array([len(t.encode()) for t in own], pa.int64()),
                                              pa.array([len(words_of(t)) for t in own], pa.int64())], ["copies", "bytes", "words"])

    return items.select("text", "copies").mapInArrow(run, "copies long, bytes long, words long")


def frequencies(items: DataFrame, rows: list[tuple[int, str, int]]) -> dict[str, int]:
    """In how many of all items each word of these rows occurs."""
    wanted = sorted({w for _, t, _ in rows for w in words_of(t)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = set(wanted), Counter()
        for b in batches:
            for t, n in zip(texts(b.column("text")), b.column("copies").to_pylist()):
                seen.update(dict.fromkeys(own.intersection(words_of(t)), n))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    got = items.select("text", "copies").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got["word"].to_pylist(), got["n"].to_pylist()))


def searched(docs: DataFrame, index: Index, name: str = "_found") -> DataFrame:
    """``docs`` with the findings of one shard as a list of structs, under the given name."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item", pa.int64()), ("passage", pa.int64()), ("score", pa.float64()),
                               ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    names = ("item", "passage", "score", "question_overlap", "answer_overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [[dict(zip(names, r)) for r in own] for own in shared.value.search(texts(b.column("text")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T._parse_datatype_string(FOUND)))]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, passage (its first word), score, question_overlap, answer_overlap of every verified finding."""
    rows = docs.select("doc_id", "text")
    out = None
    for index in indexes(benchmark):
        got = searched(rows, index).drop("text").select("doc_id", F.explode("_found").alias("f")) \
            .select("doc_id", F.col("f.item").alias("item_id"), "f.passage", "f.score", "f.question_overlap", "f.answer_overlap")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + FOUND.replace("item long", "item_id long"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified finding, with their columns."""
    for index in indexes(benchmark):
        name = unused(docs, "_found")
        docs = searched(docs, index, name).where(F.size(name) == 0).drop(name)
    return docs
