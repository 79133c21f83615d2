"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is described by its mix of byte classes (letters,
capitals, signs, ...), the class pairs beside one another, and its words, and encoded by one hidden layer. Gated
attention, learnt from document labels alone, weighs the passages; the weighted representation gives the score. The
model is fitted on a bounded sample of labelled documents and applied to whole texts.

Defined results: a null or empty text has one empty passage and is scored like any other; with no labels the score is
0.5; rows may repeat; only the text is an input of a score; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import flat, fold, slices, spread_sample, unused

#: Labelled documents of each kind that the model is fitted on, at most about so many.
FIT_DOCS = 1500
PASSAGE = 512
HIDDEN, GATE = 32, 16


def class_table() -> np.ndarray:
    """Class of every byte: 0 small letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 stop, 6 comma, 7 exclamation or
    question mark, 8 bar, slash or bracket, 9 other sign, 10 control, 11 part of a letter beyond ASCII."""
    t = np.full(256, 9, np.uint8)
    t[:32], t[127], t[128:] = 10, 10, 11
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3),
                     (b"\r\n", 4), (b".:;", 5), (b",", 6), (b"!?", 7), (b"|/\\<>{}[]()", 8)):
        t[list(chars)] = k
    return t


CLASSES = 12
FEATURES = CLASSES * CLASSES + CLASSES + 4


def passages(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of every text (n + 1 places)."""
    size = np.diff(at)
    n = np.maximum(1, -(-size // PASSAGE))
    first = np.r_[0, np.cumsum(n)]
    row = np.repeat(np.arange(len(size)), n)
    start = at[:-1][row] + (np.arange(len(row)) - first[row]) * PASSAGE
    length = np.minimum(start + PASSAGE, at[1:][row]) - start
    own = np.repeat(np.arange(len(row)), length)
    kind = class_table()[body].astype(np.int64)
    x = np.zeros((len(row), FEATURES), np.float32)
    per = np.maximum(length, 1)[:, None]
    x[:, :CLASSES] = np.bincount(own * CLASSES + kind, minlength=len(row) * CLASSES).reshape(-1, CLASSES) / per
    if len(body) > 1:
        same = own[1:] == own[:-1]
        pair = (own[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
        x[:, CLASSES:CLASSES * (CLASSES + 1)] = np.bincount(pair[same], minlength=len(row) * CLASSES**2).reshape(-1, CLASSES**2) / per
    if len(body):
        blank = (kind == 3) | (kind == 4)
        cut = np.r_[True, own[1:] != own[:-1]]
        begin = np.flatnonzero(~blank & (cut | np.r_[True, blank[:-1]]))
        word_of = own[begin]
        words = np.bincount(word_of, minlength=len(row))
        if len(begin):
            total = np.cumsum(np.r_[0, (body.astype(np.int64) + 7) * ~blank])
            square = np.cumsum(np.r_[0, (body.astype(np.int64) + 7)**2 * ~blank])
            end = np.r_[begin[1:], len(body)]
            sign = (total[end] - total[begin]) * 65_599 + square[end] - square[begin]
            near = np.r_[False, (sign[1:] == sign[:-1]) & (word_of[1:] == word_of[:-1])]
            x[:, -4] = np.bincount(word_of, near, len(row)) / np.maximum(words, 1)
            inside = np.bincount(own, ~blank, len(row))
            x[:, -3] = inside / np.maximum(words, 1) / 10
            x[:, -2] = words / per[:, 0]
    x[:, -1] = length / PASSAGE
    return x, first


@dataclass
class QualityModel:
    """Parameters; ``shift`` and ``scale`` standardise the features."""

    w: dict[str, np.ndarray] | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None

    def score(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(at) - 1, 0.5)
        x, first = passages(body, at)
        return forward(self.w, (x - self.shift) / self.scale, first)["p"]


def forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Encoded passages, gated attention within each bag, weighted representation, score."""
    bag, row = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ w["enc"] + w["enc0"])
    tanh, gate = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (tanh * gate) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, bag)[row])
    a = e / np.add.reduceat(e, bag)[row]
    z = np.add.reduceat(a[:, None] * h, bag, axis=0)
    return {"h": h, "tanh": tanh, "gate": gate, "a": a, "z": z, "row": row, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(w, x, first)
    bag, row = first[:-1], f["row"]
    d = weight * (f["p"] - y) / weight.sum()
    dz = d[:, None] * w["c"]
    da = (f["h"] * dz[row]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, bag)[row])
    dt = de[:, None] * w["a"] * f["gate"] * (1 - f["tanh"]**2)
    dg = de[:, None] * w["a"] * f["tanh"] * f["gate"] * (1 - f["gate"])
    dh = f["a"][:, None] * dz[row] + dt @ w["v"].T + dg @ w["u"].T
    dp = dh * (1 - f["h"]**2)
    return {"enc": x.T @ dp, "enc0": dp.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["tanh"] * f["gate"]).T @ de,
            "c": f["z"].T @ d, "c0": np.array(d.sum())}


def fit_bags(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 30, batch: int = 128,
             rate: float = 3e-3, decay: float = 1e-4) -> QualityModel:
    """Parameters by Adam over batches of documents."""
    rng = np.random.default_rng(11)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = (x - shift) / scale
    w = {"enc": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "enc0": np.zeros(HIDDEN),
         "v": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "u": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
         "a": rng.normal(0, 0.1, GATE), "c": rng.normal(0, 0.1, HIDDEN), "c0": np.array(0.0)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            docs = order[s:s + batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            g = gradients(w, x[rows], np.r_[0, np.cumsum(first[docs + 1] - first[docs])], y[docs], weight[docs])
            step += 1
            for k in w:
                grad = g[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel({k: p.astype(np.float32) for k, p in w.items()}, shift, scale)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> QualityModel:
    """Model from the documents that ``labels`` (doc_id, quality) marks; a bounded number of each kind is used."""
    marks = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null") \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return QualityModel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, first = passages(*flat(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(np.diff(first), pa.int32()),
                                              pa.array([x[s:e].tobytes() for s, e in zip(first, first[1:])], pa.binary())],
                                             ["doc_id", "quality", "n", "x"])

    some = spread_sample(marks.where("quality = 0"), "doc_id", most).unionByName(spread_sample(marks.where("quality = 1"), "doc_id", most))
    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id") \
        .mapInArrow(run, "doc_id bigint, quality int, n int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = got["quality"].to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return QualityModel()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    weight = np.where(y == 1, seen[1] / max(1, (y == 1).sum()), seen[0] / max(1, (y == 0).sum()))
    return fit_bags(x, np.r_[0, np.cumsum(got["n"].to_numpy())], y, weight / weight.mean())


def score(docs: DataFrame, model: QualityModel, passed_on: list[str] | None = None, name: str = "_score") -> DataFrame:
    """doc_id (or the columns to be passed on, ``text`` among them) and score, under the given name, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = passed_on or ["doc_id"]
    source = docs.select(*dict.fromkeys([*kept, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = shared.value.score(*flat(b.column("text"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p.astype(np.float64))], [*kept, name])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt only where the fold by three is not 1."""
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
                                     (F.col("_score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    name = unused(docs, "_score")
    return score(docs, model, docs.columns, name).where(F.col(name) >= threshold).drop(name)
