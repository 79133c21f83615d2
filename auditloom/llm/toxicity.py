"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled documents. The ordinary one holds prose of
ordinary documents. The toxic one holds the same prose, as toxic documents are mostly made of it too, and behind it what
sets toxic documents apart: the words (or beginnings of words) whose share of toxic documents is significantly larger.
Every window of a text is compressed with both; the bytes that the toxic dictionary saves are compared with thresholds
at several levels, and a logistic curve calibrated on documents that neither dictionary has seen makes them a score.

Defined results: a null or empty text has no window and gets the score of a text that saves nothing; without labels of
both kinds every score is 0; rows may repeat; columns other than doc_id and text are never inputs of a score; an empty
table gives an empty table; texts are scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import flat, fold, slices, spread_sample, texts

#: Labelled documents of each kind that the model is fitted on, at most about so many.
FIT_DOCS = 1500
WINDOW = 64
#: Prose in both dictionaries, and telling pieces in the toxic one.
PROSE_BYTES, TELLING_BYTES = 65_536, 16_384
LEVEL = 3
#: Savings of a window, in bytes, that count; what is above each of them is summed per text.
THRESHOLDS = (2, 3, 5)
#: Least log-likelihood ratio of a telling word.
LEAST_RATIO = 20.0


def windows(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each window and the text it belongs to. Windows overlap by half, so that no short phrase
    is cut in all of its windows; the last window of a text ends with the text."""
    size = np.diff(at)
    n = np.where(size == 0, 0, np.maximum(1, -(-(size - WINDOW) // (WINDOW // 2)) + 1))
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][row] + np.minimum(k * (WINDOW // 2), np.maximum(0, size[row] - WINDOW))
    return start, np.minimum(WINDOW, size[row]), row


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3 + len(THRESHOLDS)))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                                                           format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=18)
        out = []
        for d in (self.toxic, self.ordinary):
            content = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=content, compression_params=p))
        return out

    def saved(self, body: np.ndarray, at: np.ndarray, tools: list[zstandard.ZstdCompressor]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the toxic dictionary saves against the ordinary one, and the text, of each window."""
        start, size, row = windows(body, at)
        if not len(start):
            return np.zeros(0), row
        cuts = zstandard.BufferWithSegments(body.tobytes(), np.c_[start, size].astype("<u8").tobytes())
        toxic, ordinary = (np.frombuffer(bytes(sizes(c, cuts)), np.int32) for c in tools)
        return (ordinary - toxic).astype(np.float64), row

    def features(self, body: np.ndarray, at: np.ndarray, tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
        """Per text: 1, the largest saving, savings above each threshold for its number of windows, log of that number."""
        gain, row = self.saved(body, at, tools)
        n = len(at) - 1
        top, over = np.zeros(n), np.zeros((n, len(THRESHOLDS)))
        np.maximum.at(top, row, gain)
        for k, t in enumerate(THRESHOLDS):
            over[:, k] = np.bincount(row, np.maximum(0, gain - t), n)
        count = np.bincount(row, minlength=n)
        return np.c_[np.ones(n), top, over / np.sqrt(count + 1)[:, None], np.log1p(count)]

    def score(self, body: np.ndarray, at: np.ndarray, tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(self.features(body, at, tools) @ self.curve, -30, 30)))


def sizes(tool: zstandard.ZstdCompressor, cuts: zstandard.BufferWithSegments) -> pa.Buffer:
    got = tool.multi_compress_to_buffer(cuts, threads=1)
    return np.fromiter((len(got[i]) for i in range(len(got))), np.int32, len(got)).tobytes()


def once(rows: list[str]) -> list[str]:
    """One text of each group that shares the smallest hash of five words: copies must not make a word frequent."""
    seen: dict[int, str] = {}
    for t in rows:
        w = t.lower().split()
        seen.setdefault(min((zlib.crc32(" ".join(w[k:k + 5]).encode()) for k in range(max(1, len(w) - 4))), default=0), t)
    return list(seen.values())


def stems(word: str) -> list[str]:
    return [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]


def telling_words(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words, and beginnings of words, whose share of toxic documents is significantly above that of ordinary ones."""
    def counted(rows: list[str]) -> Counter:
        c: Counter = Counter()
        for t in rows:
            words = set(re.findall(r"\w+", t.lower()))
            c.update(words.union(*map(stems, words)))
        return c

    t, o = counted(toxic), counted(ordinary)
    part = len(toxic) / (len(toxic) + len(ordinary))
    found = set()
    for w, n in t.items():
        m, expected = o[w], (n + o[w]) * part
        if n > 1.5 * expected:
            ratio = 2 * (n * math.log(n / expected) + (m * math.log(m / ((n + m) * (1 - part))) if m else 0.0))
            if ratio >= LEAST_RATIO:
                found.add(w)
    return found


def telling_pieces(rows: list[str], telling: set[str]) -> bytes:
    """Telling words with the sign on either side, the most frequent ones last, where they are cheapest to refer to."""
    seen: Counter = Counter()
    for t in rows:
        for m in re.finditer(r"\w+", t):
            w = m[0].lower()
            if w in telling or any(x in telling for x in stems(w)):
                seen[t[max(0, m.start() - 1):m.end() + 1].encode()] += 1
    kept, size = [], 0
    for piece, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if size + len(piece) > TELLING_BYTES:
            break
        kept.append(piece)
        size += len(piece)
    return b"".join(reversed(kept))


def prose(rows: list[str], most: int = PROSE_BYTES, piece: int = 512) -> bytes:
    """Pieces from all over the texts, in a fixed random order."""
    whole = b" ".join(t.encode() for t in rows)
    starts = np.arange(0, max(1, len(whole) - piece + 1), piece)
    np.random.default_rng(3).shuffle(starts)
    return b"".join(whole[s:s + piece] for s in starts[:most // piece].tolist())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_texts(toxic: list[str], ordinary: list[str], shares: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """Model from texts of both kinds; ``shares`` weigh them as in the whole. Two thirds of the texts train the
    dictionaries, the others set the curve."""
    toxic, ordinary = once(toxic), once(ordinary)
    if not toxic or not ordinary:
        return ToxicityModel()
    tune = [[t for i, t in enumerate(rows) if i % 3 == 2] or rows for rows in (toxic, ordinary)]
    rest = [[t for i, t in enumerate(rows) if i % 3 != 2] or rows for rows in (toxic, ordinary)]
    base = prose(rest[1]).ljust(16, b" ")
    model = ToxicityModel(base + telling_pieces(rest[0], telling_words(*rest)), base)
    tools = model.compressors()
    x = [model.features(*flat(pa.array(rows, pa.large_string())), tools) for rows in tune]
    y = np.r_[np.ones(len(x[0])), np.zeros(len(x[1]))]
    weight = np.r_[np.full(len(x[0]), shares[0] / len(x[0])), np.full(len(x[1]), shares[1] / len(x[1]))]
    model.curve = logistic(np.vstack(x), y, weight * len(y) / weight.sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> ToxicityModel:
    """Model from the documents that ``labels`` (doc_id, toxic) marks; a bounded number of each kind is used."""
    marks = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows: dict[int, list[str]] = {}
    for kind in (1, 0):
        some = spread_sample(marks.where(F.col("toxic") == kind), "doc_id", most)
        got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", "text").toArrow()
        rows[kind] = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])["text"].to_pylist()
    return fit_texts(rows[1], rows[0], (seen.get(1, 0), seen.get(0, 0)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = shared.value.compressors() if shared.value.toxic else []
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(*flat(b.column("text")), tools), pa.float64())],
                                             ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt only where the fold by four is not 2."""
    model = fit(docs, labels.where(fold("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))
