"""The corpus pipeline stage by stage against plain versions."""

from __future__ import annotations

import re

import corpus_pipeline as P
from auditloom.functions.cut import written
from auditloom.llm import decontaminate, quality, queries
from tests.llm.brute import byte_repeats, shingle_components

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    labels, items = queries.table(spark, SF, "labels"), queries.table(spark, SF, "benchmark")
    seen = []
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = written(stage(spark, docs, SF))
        seen.append(name)
        if name == "tokens":
            assert {r.doc_id for r in after.collect()} == {i for i, _ in before} and "token_ids" in after.columns
            break
        assert after.columns == columns
        got = {r.doc_id: r.text for r in after.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
            assert set(got) == want and len(want) > 800
        elif name == "near_duplicates":
            assert set(got) == {i for (i, _, c) in shingle_components(before, 5, 80) if i == c} and len(got) < len(before)
        elif name == "repeated_passages":
            plain = {i: n - gone for i, n, gone, _, _ in byte_repeats(before)}
            assert all(0 <= plain[i] - len(t.encode()) <= 6 * 20 for i, t in got.items()) and sum(plain.values()) < sum(len(t.encode()) for _, t in before)
        else:
            leaks = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
            assert set(got) == {i for i, _ in before} - leaks
            kept = " ".join(re.findall(r"\w+", " ".join(got.values()).lower()))
            assert not any(" ".join(re.findall(r"\w+", r.text.lower())) in kept for r in items.collect())
        docs = after
    assert seen == ["quality", "near_duplicates", "repeated_passages", "benchmark", "tokens"]


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(rows.columns) and rows.count() > 50
