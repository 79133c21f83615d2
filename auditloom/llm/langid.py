"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased code points (anything but letters counts as a space). Document
frequencies come from every document that may be learnt from. Weights are learnt by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of labelled documents, in which every language has some; offsets are corrected for the true
shares of the languages. A part of the sample that the weights did not see sets the temperature that makes scores
probabilities. Prediction reads whole texts: term frequency is relative, so a score is a
sum over all places of a text.

Defined results: ``und`` with score 0 for a null text or one without a letter; with no labelled document every text with
a letter is ``und`` as well; rows may repeat; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import fold, slices, texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that the model is fitted on, about so many, and more if a language would have less than ``LEAST_DOCS``.
FIT_DOCS, LEAST_DOCS = 3000, 100
SCALE = 30.0


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point: itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    table[letters] = letters
    return table


def grams(rows: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each place, one array per order; places outside a text are -1.

    Every text is framed by spaces. Also returns where each text starts and its number of n-grams.
    """
    framed = [" " + t.lower() + "  " for t in rows]
    size = np.fromiter(map(len, framed), np.int64, len(framed))
    code = letter_table()[np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    start = np.cumsum(size) - size
    end = np.repeat(start + size, size)
    out, total = [], np.zeros(len(framed), np.int64)
    for n in ORDERS:
        h = np.full(len(code), n, np.uint64)
        for j in range(n):
            h = (h + np.r_[code[j:], np.zeros(min(j, len(code)), np.uint64)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        b = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
        b[np.arange(len(code)) + n > end] = -1
        out.append(b)
        total += np.maximum(size - n + 1, 0)
    return out, start, total


def bags(rows: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and relative frequencies of every text."""
    orders, start, total = grams(rows)
    at = [*start.tolist(), len(orders[0])]
    result = []
    for k in range(len(rows)):
        own = np.concatenate([b[at[k]:at[k + 1]] for b in orders])
        n = np.bincount(own[own >= 0], minlength=BUCKETS)
        ids = np.flatnonzero(n)
        result.append((ids.astype(np.int32), (n[ids] / max(1, total[k])).astype(np.float32)))
    return result


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, over all documents, and the number of documents.

    Each task counts in one array of fixed size; the arrays are summed in blocks on the executors.
    """
    block = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_in, n = np.zeros(BUCKETS, np.int64), 0
        for b in slices(batches):
            rows = texts(b.column("text"))
            orders, start, _ = grams(rows)
            at = [*start.tolist(), len(orders[0])]
            for k in range(len(rows)):
                seen = np.zeros(BUCKETS + 1, bool)  # the last place takes the -1 of places outside a text
                for o in orders:
                    seen[o[at[k]:at[k + 1]]] = True
                seen_in += seen[:-1]
            n += len(rows)
        counts = np.r_[seen_in, n, np.zeros(block - 1, np.int64)].reshape(-1, block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts.tolist(), pa.list_(pa.int64()))],
                                         ["block", "counts"])

    part = docs.select("text").mapInArrow(run, "block int, counts array<bigint>")
    place = part.select("block", F.posexplode("counts").alias("place", "n")).where("n > 0")
    rows = place.groupBy("block", "place").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(BUCKETS + block, np.int64)
    flat[rows["block"].to_numpy() * block + rows["place"].to_numpy()] = rows["n"].to_numpy()
    return flat[:BUCKETS], int(flat[BUCKETS])


@dataclass
class LanguageModel:
    """Weights (idf included) of each bucket and language, offsets, temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, rows: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not rows:
            return ["und"] * len(rows), np.zeros(len(rows))
        orders, start, total = grams(rows)
        table = np.vstack([self.weights, np.zeros((1, len(self.langs)))]).astype(np.float32)  # -1 takes the zeros
        z = sum(np.add.reduceat(table[b], start, axis=0).astype(np.float64) for b in orders)
        p = softmax((SCALE * z / np.maximum(total, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        known = np.array([any(map(str.isalpha, t)) for t in rows])
        return [self.langs[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, p[np.arange(len(rows)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_leader(bag: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, idf: np.ndarray, epochs: int = 3,
                  alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets by FTRL-proximal steps, one document at a time; l1 keeps most weights at zero."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weight(ids: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[ids]) <= l1, 0.0, -(z[ids] - np.sign(z[ids]) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(bag)):
            ids, tf = bag[k]
            ids, x = np.r_[ids, BUCKETS], np.r_[SCALE * tf * idf[ids], 1.0]
            w = weight(ids)
            g = softmax(x @ w)
            g[label[k]] -= 1.0
            step = x[:, None] * g
            sigma = (np.sqrt(n[ids] + step**2) - np.sqrt(n[ids])) / alpha
            z[ids] += step - sigma * w
            n[ids] += step**2
    w = weight(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def temperature_of(z: np.ndarray, label: np.ndarray, shift: np.ndarray) -> float:
    """The temperature with the least log loss, by a search over a grid; ``shift``: logarithm of a class's share of all rows over
    its share of the sample."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 80))
    weight = np.exp(shift)[label]
    loss = [-(weight * np.log(np.maximum(softmax(z / t + shift)[np.arange(len(z)), label], 1e-12))).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def language_sample(labelled: DataFrame, most: int) -> tuple[DataFrame, dict[str, int]]:
    """About ``most`` rows, chosen by a hash, and about ``LEAST_DOCS`` of each language that would have less (all, if it has
    no more); the rows of every language."""
    seen = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = most / max(1, sum(seen.values()))
    if part >= 1:
        return labelled, seen
    own = {x: min(1.0, max(part, LEAST_DOCS / n)) for x, n in seen.items()}
    low = labelled.sparkSession.createDataFrame([(x, int(2**62 * p)) for x, p in own.items()], "lang string, _low long")
    rows = labelled.join(F.broadcast(low), "lang")
    return rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "text"), 2) < F.col("_low")).drop("_low"), seen


def fit(docs: DataFrame, labelled: DataFrame, most: int = FIT_DOCS) -> LanguageModel:
    """Model from ``labelled`` (doc_id, text, lang); document frequencies are those of all ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = bags(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([x for x, _ in own], pa.list_(pa.int32())),
                                              pa.array([x for _, x in own], pa.list_(pa.float32()))], ["doc_id", "lang", "ids", "tf"])

    sample, seen = language_sample(labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null"), most)
    got = sample.mapInArrow(run, "doc_id bigint, lang string, ids array<int>, tf array<float>").toArrow().sort_by("doc_id")
    lang = got["lang"].to_pylist()
    langs = sorted(set(lang))
    df, n = document_frequency(docs)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    idf = np.log((1 + n) / (1 + df)) + 1.0
    bag = [(np.asarray(i.values), np.asarray(t.values)) for i, t in zip(got["ids"], got["tf"])]
    label = np.array([langs.index(x) for x in lang])
    # Every fifth document of a language, so that no language is only in the part that the weights do not see.
    tune = np.zeros(len(bag), bool)
    for k in range(len(langs)):
        tune[np.flatnonzero(label == k)[4::5]] = True
    w, b = follow_leader([x for x, t in zip(bag, tune) if not t], label[~tune], len(langs), idf)
    z = np.array([SCALE * (tf * idf[ids]) @ w[ids] + b for (ids, tf), t in zip(bag, tune) if t])
    true = np.array([seen[x] for x in langs], float)
    shift = np.log(true / true.sum()) - np.log(np.bincount(label) / len(label))
    t = temperature_of(z, label[tune], shift) if len(z) else 1.0
    return LanguageModel(langs, w * idf[:, None], b + t * shift, t)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = shared.value.predict(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt, frequencies included, from labelled documents whose fold by five is not 0."""
    known = docs.where((fold("doc_id", 5) != 0) & F.col("lang").isNotNull())
    model = fit(known, known)
    return predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
