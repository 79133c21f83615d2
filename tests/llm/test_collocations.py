"""Phrase collocations against counts in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from auditloom.llm import collocations as K

SCHEMA = "doc_id long, text string, lang string, shard int, phrase string, bucket int, f string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 9, "p", 1, "q") for i, t, g in rows], SCHEMA)


def counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, least, share, first):
    f, n = counts(rows)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(inside[lang, w[i:i + k]], a)
    rows = {}
    for (lang, w), a in cand.items():
        if 100 * inside[lang, w] < share * a or not inside[lang, w]:
            score, k, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:first])]


def texts(seed):
    r = random.Random(seed)
    voc = [f"{a}{b}" for a in "abcdé日" for b in ("", "x", "yz", "\xa0q")]
    fixed = [" ".join(r.choice(voc) for _ in range(r.randrange(2, 7))) for _ in range(12)]
    gap = [" ", "  ", "\t", ", ", ". ", "\n", " \x0b", " \t ", "!", "\r\n"]
    rows = []
    for i in range(160):
        t = "".join((r.choice(fixed) if r.random() < .3 else r.choice(voc)) + (r.choice(gap) if r.random() < .3 else " ") for _ in range(r.randrange(0, 40)))
        rows.append((i, t.upper() if r.random() < .2 else t, r.choice(["en", "fr", None, "und", ""])))
    # Phrases that become frequent only in the last scan of a cycle, repeated rows, odd texts.
    rows += [(200, "a rare one here. " * 7, "fr"), (201, None, "en"), (202, "", None), (203, " .,\t", "en"), (204, "z" * 5000, "en"), (None, "a b a b a b", "en")]
    rows += [(300, "same same same same same", "en")] * 9 + [(301, "hot pair hot pair", "fr")] * 60
    return rows


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations(spark, shards):
    rows = texts(shards)
    got = [tuple(r) for r in K.collocations(frame(spark, rows), least=6, first=40, shards=shards).collect()]
    assert sorted(got) == sorted(plain(rows, 6, 80, 40)) and len(got) > 60


def test_crowded_cells(spark):
    """A table of cells that is too small makes more candidates and the same result; so do tasks that send early."""
    rows = texts(7)
    got = {(r.lang, r.phrase): r.f for r in K.frequent(frame(spark, rows), least=5, shards=2, cell_bits=7, held=200).where("length > 0").collect()}
    f, _ = counts(rows)
    assert got == {(lang, " ".join(w)): n for (lang, w), n in f.items() if n >= 5}


def test_nothing(spark):
    assert K.collocations(frame(spark, [])).count() == 0
    assert K.collocations(frame(spark, [(1, "a few words", "en")])).count() == 0


def test_packing():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (K.unpack_keys(K.pack_keys(keys)) == keys).all() and (K.unpack(K.pack(np.array([1, 300, 2**40]))) == [1, 300, 2**40]).all()


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("(cast(2000000 as decimal(10,0)) * cast(9000000000000000000 as decimal(19,0))) div (cast(9000000000000000000 as decimal(19,0)) + cast(9000000000000000000 as decimal(19,0))) as s").first()
    assert row.s == 1_000_000
