"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def byte_repeats(rows: list[tuple], length: int = 200) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text)."""
    seen: dict[bytes, int] = defaultdict(int)
    bodies = [(t or "").encode() for _, t in rows]
    for b in bodies:
        for k in range(len(b) - length + 1):
            seen[hashlib.blake2b(b[k:k + length], digest_size=16).digest()] += 1
    out = []
    for (i, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[k:k + length], digest_size=16).digest()] > 1:
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return out


def word_repeats(rows: list[tuple], width: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text); null ids last."""
    own = [WORD.findall(t or "") for _, t in rows]
    rank = [float("inf") if i is None else i for i, _ in rows]
    least: dict[tuple, float] = {}
    for r, w in zip(rank, own):
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            least[key] = min(least.get(key, float("inf")), r)
    out = []
    for (i, _), r, w in zip(rows, rank, own):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < r:
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def shingle_components(rows: list[tuple], width: int = 4, percent: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    least: dict[int, object] = {}
    for k, (i, _) in enumerate(rows):
        r = top(k)
        if i is not None:
            least[r] = i if least.get(r) is None else min(least[r], i)
        else:
            least.setdefault(r, None)
    return [(i, len(s), least[top(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]
