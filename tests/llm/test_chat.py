"""Chat formatting against plain Python, with odd rows."""

from __future__ import annotations

import hashlib
import random

from auditloom.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, _turns string, example int, loss string, _lone string"


def frame(spark, rows):
    """Rows with columns whose names the operator uses for its own."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    groups = {}
    for i, (c, t, role, text) in enumerate(rows):
        groups.setdefault(("alone", i) if c is None else c, []).append((t is None, t or 0, role or "", text or ""))
    out = []
    for c, turns in groups.items():
        turns.sort()
        content = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((None if isinstance(c, tuple) else c, len(turns), sha(content), len(loss), sha(loss)))
    return out


def odd_rows():
    r = random.Random(5)
    bits = ["<s>", "</s>", "<&s>", "<&&/s>", "<", "&", "s>", "\n", "é😀", "word ", "[INST]", "\\", "$1", "</", "<s"]
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 9)):
            rows.append((c, r.choice([t, t, t, 0, None]), r.choice(["user", "assistant", "assistant", "system", None, "to\nol", "<s>&n", ""]),
                         r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randrange(12)))])))
    rows += [(50, 0, "assistant", "same")] * 3 + [(None, 1, "assistant", "alone")] * 3 + [(None, 1, "user", "</s>")] + [(51, 0, "assistant", "long " * 200_000)]
    r.shuffle(rows)
    return rows


def order(row):
    return tuple((v is None, v or 0) for v in row)


def test_round_trip(spark):
    rows = odd_rows()
    got = chat.read_back(chat.formatted(frame(spark, rows))).collect()
    assert sorted(((g.conv_id, g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for g in got), key=order) == sorted(plain(rows), key=order)


def test_examples(spark):
    rows = [(1, 0, "user", "a</s>"), (1, 1, "assistant", "b<s>"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "q"), (3, 0, "assistant", None)]
    got = {(e.conv_id, e.example): e for e in chat.formatted(frame(spark, rows)).collect()}
    one = "<s>user\na<&/s></s><s>assistant\nb<&s></s>"
    assert {k: (e.text, [e.text[x.start:x.end] for x in e.loss]) for k, e in got.items()} == {
        (1, 1): (one, ["b<&s>"]), (1, 2): (one + "<s>user\nc</s><s>assistant\nd</s>", ["d"]),
        (2, 1): ("<s>user\nq</s>", []), (3, 1): ("<s>assistant\n</s>", [""])}


def test_planted_and_empty(spark):
    empty = frame(spark, [])
    (row,) = chat.read_back(chat.formatted(chat.planted(empty))).collect()
    assert (row.conv_id, row.n_turns, row.loss_chars, row.loss_sha256) == (-1, 2, len(chat.PLANTED), sha(chat.PLANTED))
    assert chat.read_back(chat.formatted(empty)).count() == 0


def test_one_shuffle_and_no_python(spark):
    plan = queries.op12_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
