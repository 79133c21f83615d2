"""Operators on texts against plain versions and the libraries they must agree with."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditloom.llm import bpe, chunks, decontaminate, jaccard, queries, sampling, substring, suffixes
from tests.llm.brute import byte_repeats, sha, shingle_components, word_repeats

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, _chunk string, cls string, score string"


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def frame(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use for their own."""
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], SCHEMA)


def passages(seed, letters="abcdeé", n=60):
    """Texts that share parts of some passages, and odd ones: null, empty, periodic, repeated rows, equal ids, no id."""
    r = random.Random(seed)
    voc = ["".join(r.choice(letters) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    shared = [" ".join(r.choice(voc) for _ in range(r.randrange(20, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = " ".join(r.choice(voc) for _ in range(r.randrange(0, 150)))
        for _ in range(r.randrange(0, 3)):
            p = r.choice(shared)
            p = p[r.randrange(0, len(p) // 3):len(p) - r.randrange(0, len(p) // 3)]
            at = r.randrange(0, len(t) + 1)
            t = t[:at] + " " + p + "\t" + t[at:]
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, "ab" * 400), (63, "x" * 999), (64, rows[3][1]), (65, rows[3][1]), (65, rows[3][1]), (5, rows[7][1]),
             (None, rows[8][1]), (66, "y" * 199), (67, "y" * 200), (68, "ab " * 3000)]
    r.shuffle(rows)
    return rows


def families(seed):
    """Near copies of short and long texts, and sets of one to three words."""
    r = random.Random(seed)
    voc = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(10):
        base = [r.choice(voc) for _ in range(r.randrange(1, 90))]
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(voc)
            rows.append((len(rows), " ".join(w).upper() if r.random() < .2 else "  ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, rows[0][1]), (903, rows[0][1]), (None, rows[1][1]), (None, "solo text here"), (904, "a b"),
             (905, "A b"), (906, "a b c"), (907, "Ä b"), (908, "ä b")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_bytes,hot", [(4000, 3), (4000, 20_000), (1 << 20, 8)])
def test_byte_repeats(spark, chunk_bytes, hot):
    rows = passages(3)
    got = suffixes.without_repeats(frame(spark, rows), chunk_bytes, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got), key=key) == sorted(byte_repeats(rows), key=key)


def uneven(seed=9):
    """Ids whose texts are long in one place, one id and no id with many rows."""
    r = random.Random(seed)
    voc = ["".join(r.choice("abcde") for _ in range(r.randrange(2, 6))) for _ in range(80)]

    def text(n):
        return " ".join(r.choice(voc) for _ in range(n))
    rows = [(i, text(10)) for i in range(400)] + [(i, text(300)) for i in range(400, 440)] + [(i, text(10)) for i in range(440, 800)]
    rows += [(600, text(60)) for _ in range(200)] + [(None, text(60)) for _ in range(200)]
    rows += [(i, rows[k][1]) for i, k in ((600, 900), (601, 901), (100, 902), (None, 1100), (600, 1101), (5, 405))]
    r.shuffle(rows)
    return rows


def test_chunks_are_bounded_by_bytes(spark):
    most = 8000
    texts, size = chunks.chunked(frame(spark, uneven()), most)
    got = [(r._chunk, r._range, r.doc_id, len(r.text)) for r in texts.collect()]
    held, ids = Counter(), defaultdict(set)
    for c, k, i, n in got:
        held[c] += n
        ids[k].add(float("inf") if i is None else i)
    assert size == sum(held.values()) and max(held.values()) < 2 * most
    order = [ids[k] for k in sorted(ids)]
    assert all(max(a) < min(b) for a, b in zip(order, order[1:]))
    assert all(len(ids[k]) == 1 for k in ids if len({c for c, x, _, _ in got if x == k}) > 1)


def test_repeats_in_split_ids(spark):
    rows = uneven()
    got = substring.without_repeats(frame(spark, rows), 8000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.kept.encode())) for r in got), key=key) == sorted(word_repeats(rows), key=key)
    got = suffixes.without_repeats(frame(spark, rows), 8000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got), key=key) == sorted(byte_repeats(rows), key=key)


def test_groups_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 1000)
    classes = spark.range(40).selectExpr("id AS cls", "7L AS least", "cast(repeat('x', 400) AS binary) AS tokens")
    assert jaccard.grouped(classes).select("grp").distinct().count() >= 10
    rows = families(5)
    got = jaccard.linked_documents(frame(spark, rows), chunk_bytes=3000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(shingle_components(rows), key=key)


def test_anchors_fill_their_buckets_evenly():
    body = np.random.default_rng(6).integers(97, 123, 1 << 20).astype(np.uint8)
    keys = np.unique(suffixes.Occurrences.of(body, np.array([0, len(body)])).anchor)
    for bits in (5, 7):
        size = [e - s for _, s, e in chunks.dealt(keys, bits)]
        assert len(size) == 2**bits and max(size) < 2 * len(keys) / 2**bits


def test_cleaned_texts_keep_their_columns(spark):
    rows = passages(4)
    df = frame(spark, rows).selectExpr("*", "length(text) AS n_chars")
    got = suffixes.cleaned(df)
    assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    plain = Counter((i, n, removed) for i, n, removed, _, _ in byte_repeats(rows))
    assert got.count() == len(rows)
    assert sum(x[1] - x[2] for x in plain.elements()) >= sum(len((r.text or "").encode()) for r in got.collect())
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.collect())


@pytest.mark.parametrize("chunk_bytes", [4000, 1 << 20])
def test_word_repeats(spark, chunk_bytes):
    rows = passages(5)
    got = substring.without_repeats(frame(spark, rows), chunk_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.kept.encode())) for r in got), key=key) == sorted(word_repeats(rows), key=key)


@pytest.mark.parametrize("group", [3, 256])
def test_jaccard_components(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = families(group)
    got = jaccard.linked_documents(frame(spark, rows), chunk_bytes=3000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(shingle_components(rows), key=key)


def test_one_document_of_each_group_stays(spark):
    rows = [(i, t) for i, t in families(8) if i is not None]
    got = jaccard.one_of_each(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "_chunk", "cls", "score"]
    plain = {(i, t) for (i, t), (_, _, c) in zip(rows, shingle_components(rows, 5, 80)) if i == c}
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(plain, key=key)


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(1)

    def sign():
        return chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x800), r.randrange(0, 0xd800), r.randrange(0xe000, 0x110000)]))

    texts = ["", "a", "aaaa aaaa aaaaaaaaaaaaa", "<|endoftext|>x <|endoftext|>", "  \n\n x  ", "a \n b", " it's 'tis 've", "z" * 30_000, " " * 5000 + "x"]
    texts += ["".join(sign() for _ in range(r.randrange(60))) for _ in range(300)]
    rows = [*enumerate(texts), (len(texts), None), (3, texts[3])]
    df = frame(spark, rows)
    got = bpe.round_trip(df, path).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == want
    assert bpe.encode(df, path).columns == [*df.columns, "token_ids"]


def test_fingerprints(spark):
    rows = [x for x in passages(7, n=40) if x[0] != 5] + [(5, "one two"), (70, None)]
    got = sampling.compared(frame(spark, rows), 64).collect()
    assert len(got) == len(rows)
    by = {(x.doc_id, x.n_chars): x for x in got}
    texts = {x.doc_id: x for x in got}
    ring = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda x: -x[0])
    last = [(i, t or "") for i, t in rows if i is None]
    ring += last

    def alike(a, b):
        x, y = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t) if w) for t in (a, b))
        union = sum((x | y).values())
        return sum((x & y).values()) / union if union else 1.0

    errors = []
    for (i, t), (_, following) in zip(ring, [*ring[1:], ring[0]]):
        cut = len(t) // 3
        edited = t[:len(t) - cut] + following[:cut]
        x = by[(i, len(t))]
        assert x.edited_sha256 == sha(edited.encode())
        errors += [x.near_edited - alike(t, edited), x.near_next - alike(t, following)]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.3 and np.std(errors) < 0.09
    assert texts[64].fingerprint == texts[65].fingerprint and texts[61].fingerprint == ""


def test_decontamination_equals_plain_search(spark, sf_dir):
    docs, items = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    grams = defaultdict(set)
    for r in items.collect():
        w = re.findall(r"\w+", r.text.lower())
        for k in range(len(w) - 4):
            grams[tuple(w[k:k + 5])].add(r.item_id)
    size = Counter(i for own in grams.values() for i in own)
    want = set()
    for r in docs.collect():
        w = re.findall(r"\w+", r.text.lower())
        seen = Counter(i for g in {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i in grams.get(g, ()))
        want |= {(r.doc_id, i) for i, n in seen.items() if n >= 0.8 * size[i]}
    assert got == want and want
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_decontamination_shards(spark, monkeypatch, sf_dir):
    docs, items = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 15)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == whole


def test_decontamination_does_not_depend_on_shards(spark, monkeypatch):
    """One very long and many short items, Cyrillic ones, items without words and repeated rows, in one shard and in seven."""
    said = [f"\u0427\u0442\u043e \u0442\u0430\u043a\u043e\u0435 {chr(0x430 + k)}{chr(0x440 + k % 9)} \u043d\u0430 \u0441\u0430\u043c\u043e\u043c \u0434\u0435\u043b\u0435 \u0442\u0443\u0442? \u042d\u0442\u043e \u043e\u0442\u0432\u0435\u0442 {chr(0x430 + k)} \u043d\u0430 \u0432\u043e\u043f\u0440\u043e\u0441 {chr(0x450 - k)}" for k in range(20)]
    rows = [*enumerate(said), (50, " ".join(f"long{i}" for i in range(200))), (51, "?!"), *[(60, "One item that is there very many times. Yes it is so.")] * 40]
    items = spark.createDataFrame(rows, "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(90))
    docs = frame(spark, [*((k, f"{filler} {t} {filler}") for k, t in enumerate(said)), (70, filler), (71, f"{filler} one item that is there very many times. yes it is so {filler}")])
    found = []
    for most in (4000, 3):
        monkeypatch.setattr(decontaminate, "SHARD_ITEMS", most)
        found.append(sorted((r.doc_id, r.item_id, r.passage, round(r.score, 5)) for r in decontaminate.contaminated(docs, items).collect()))
    assert found[0] == found[1] and {r[:2] for r in found[0]} == {*((k, k) for k in range(20)), (71, 60)}
    assert sum(r[0] == 71 for r in found[0]) == 40
    assert max(len(i.item_ids) for i in decontaminate.indexes(items)) < 15


def test_decontamination_odd_items(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Two words"), (3, "Two words"), (4, "What is the name of it? A very odd one.")], "item_id long, text string")
    docs = frame(spark, [(1, None), (2, ""), (3, "here are two words"), (4, "so what is the name of it? a very odd one indeed"), (4, "what is the name")])
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(3, 3), (3, 3), (4, 4)]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


EMPTY = {"op1": lambda d, s: bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")), "op3": lambda d, s: jaccard.linked_documents(d),
         "op4": lambda d, s: suffixes.digests(d), "op7": lambda d, s: sampling.compared(d), "op8": lambda d, s: substring.digests(d)}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](frame(spark, [(1, "x")]).limit(0), spark).collect() == []
