"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The vocabulary is read on the driver from a file of the ``tokenizers`` library and broadcast (a fixed table of some
megabytes). A task splits its texts into pieces, looks up the pieces it has seen and merges the new ones together:
the symbols of all new pieces lie in one flat array, every neighbouring pair is looked up by binary search over the
sorted pair keys, and each round merges the lowest-rank pair of every piece, until no piece has a known pair.

Defined results: a null text is an empty text; an empty text has no tokens and decodes to an empty text; special-token
strings in a text become their single id; rows may repeat, other columns are passed on untouched
(one with the name of a new column is replaced), an empty table gives
an empty table, and the length of a text is not limited.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import SLICE_BYTES, slices, texts

# Fixed value: the byte-level splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of cuts and ids that a task remembers before it starts afresh, and what an entry takes besides.
REMEMBERED, ENTRY = 64 << 20, 160
NONE = np.iinfo(np.int64).max
#: A space between two other signs; a space at an end or beside white space.
SINGLE_SPACE, BESIDE_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\A | \s|\s | \Z")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Sorted pair keys with rank and merged id, bytes of each id, and the special strings."""

    byte_id: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    pieces: list[bytes]
    special: dict[str, int]
    span: int
    known: dict[str, bytes] = field(default_factory=dict, repr=False)
    size: int = field(default=0, repr=False)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        span = max([*vocab.values(), *special.values()]) + 1
        pieces = [b""] * span
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token) if token not in special else token.encode()
        for token, i in special.items():
            pieces[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * span + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(np.array([vocab[c] for c in letters], np.int64), keys[order], order.astype(np.int64), merged[order],
                   pieces, special, span)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE if it is no pair, and its place among the sorted keys."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers; all words advance together, a round at a time."""
        if not words:
            return []
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank, at = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], at[inside] = self.ranked(symbol[inside], symbol[inside + 1])
        done_word, done_symbol = [], []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            keep = lowest != NONE
            if not keep.all():
                done_word.append(word[~keep])
                done_symbol.append(symbol[~keep])
            hit = np.flatnonzero(keep & (rank == lowest))
            if len(hit):
                # Of overlapping hits in a run such as a a a, every second one counts, from the left.
                run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
                place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
                hit = hit[place % 2 == 0]
                symbol[hit] = self.merged[at[hit]]
                keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            word, symbol, rank, at = word[keep], symbol[keep], rank[keep], at[keep]
            if len(hit):
                # Only the pairs beside a merged symbol are looked up again.
                beside = np.zeros(len(word) + 1, bool)  # the last place takes the -1 of a first symbol
                beside[moved[hit]] = beside[moved[hit] - 1] = True
                fresh = np.flatnonzero(beside[:-1])
                rank[fresh] = NONE
                fresh = fresh[fresh < len(word) - 1]
                fresh = fresh[word[fresh] == word[fresh + 1]]
                rank[fresh], at[fresh] = self.ranked(symbol[fresh], symbol[fresh + 1])
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        flat = symbol[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        end = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *end], end)]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of texts without special strings, all merged together."""
        split = regex.compile(PATTERN).findall
        own = [split(x) for x in parts]
        pieces = list({w for x in own for w in x})
        ids = dict(zip(pieces, self.merge([w.encode() for w in pieces])))
        return [b"".join(map(ids.__getitem__, x)) for x in own]

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian 32-bit integers.

        A single space between two other signs always starts a new piece, so texts are first cut there and only
        cuts that were not seen before are split by the pattern.
        """
        special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        cuts: list[list[str]] = []
        layouts: list[list[int | str]] = []
        for t in rows:
            layout: list[int | str] = []
            for k, x in enumerate(special.split(t) if special is not None and special.search(t) else [t]):
                if k % 2:
                    layout.append(x)
                elif x:
                    layout.append(len(cuts))
                    cuts.append(SINGLE_SPACE.split(x) if BESIDE_SPACE.search(x) else x.split(" "))
            layouts.append(layout)
        wanted = {w for c in cuts for w in c[1:]}
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        new = list(wanted - self.known.keys())
        ids = self.ids_of([c[0] for c in cuts] + [" " + w for w in new])
        self.known.update(zip(new, ids[len(cuts):]))
        self.size += sum(map(len, new)) + sum(map(len, ids[len(cuts):])) + ENTRY * len(new)
        known = self.known.__getitem__
        return [b"".join(int(self.special[x]).to_bytes(4, "little") if isinstance(x, str)
                         else ids[x] + b"".join(map(known, cuts[x][1:])) for x in layout) for layout in layouts]

    def decode(self, rows: list[bytes]) -> list[str]:
        piece = self.pieces.__getitem__
        return [b"".join(map(piece, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace") for ids in rows]


def _mapped(df: DataFrame, source: str, targets: list[T.StructField], step, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with more columns, which ``step`` computes from ``source`` in bounded pieces; columns of these names are replaced,
    and those ``dropped`` go no further."""
    df = df.drop(*[t.name for t in targets if t.name in df.columns])
    kinds = [pa.large_string() if isinstance(t.dataType, T.StringType) else pa.large_binary() for t in targets]
    kept, names = [f for f in df.schema.fields if f.name not in dropped], [t.name for t in targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, source, SLICE_BYTES):
            made = [pa.array(x, k) for x, k in zip(step(b.column(source)), kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *made], [*(f.name for f in kept), *names])

    return df.mapInArrow(run, T.StructType([*kept, *targets]))


def encode(docs: DataFrame, vocabulary_path: str, column: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of a text column, packed as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.from_file(vocabulary_path))
    return _mapped(docs, column, [T.StructField(ids, T.BinaryType())], lambda c: [shared.value.encode(texts(c))])


def decode(docs: DataFrame, vocabulary_path: str, ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the text of packed token ids; bytes that are no UTF-8 become the replacement character."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.from_file(vocabulary_path))
    return _mapped(docs, ids, [T.StructField(column, T.StringType())],
                   lambda c: [shared.value.decode([x or b"" for x in c.to_pylist()])])


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digests of the packed ids and of the decoded text.

    One worker encodes a piece and decodes its ids: two steps in a row would keep two workers with a vocabulary each for a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.from_file(vocabulary_path))

    def step(c: pa.Array) -> list[list]:
        ids = shared.value.encode(texts(c))
        return [ids, shared.value.decode(ids)]

    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    both = _mapped(docs.select("doc_id", "text"), "text", fields, step, dropped=("text",))
    return both.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "token_ids")
