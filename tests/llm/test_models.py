"""Learnt operators: held-out accuracy, and texts and labels that are missing or odd."""

from __future__ import annotations

import numpy as np
import pytest

from auditloom.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 !!"), (3, "123 !!"), (None, "Some plain words."), (4, "word " * 30_000)]


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in queries.table(spark, SF, "labels").collect()}


def test_quality(spark, labels):
    rows = queries.op2_quality(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([r.predicted == labels[r.doc_id].quality for r in held]) > 0.97


def test_toxicity(spark, labels):
    rows = queries.op6_toxicity(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([r.predicted == labels[r.doc_id].toxic for r in held]) > 0.9


def test_language(spark):
    lang = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op5_language(spark, SF).collect()
    assert len(rows) == 1000 and np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_rare_languages_are_learnt(spark):
    rows = [(k, f"the house and the road number {k} of the town", "en") for k in range(2000)]
    rows += [(2000 + k, f"das Haus und die Straße Nummer {k} der Stadt", "de") for k in range(1500)]
    rows += [(4000 + k, f"το σπίτι και ο δρόμος αριθμός {k} της πόλης", "el") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, docs, most=50)
    assert model.langs == ["de", "el", "en"]
    got, _ = model.predict(["ο δρόμος της πόλης και το σπίτι", "the road of the town", "die Straße der Stadt"])
    assert got == ["el", "en", "de"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "de", "x", "y") for i, t in ODD], "doc_id long, text string, lang string, n string, _found string")
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (4, None, 1), (None, 1, 1), (3, 0, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (quality.quality(docs, marks).collect(), toxicity.toxicity(docs, marks).collect()):
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out in (True, False) for r in rows)
    rows = langid.identify(docs).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "und", "de", "de"] and all(0 <= r.score <= 1 for r in rows)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(docs, marks).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, marks).collect()} == {0.0}
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}
    for op in (quality.quality, toxicity.toxicity):
        assert op(docs.limit(0), marks).collect() == []
    assert langid.identify(docs.limit(0)).collect() == []


def test_good_documents_keep_their_columns(spark):
    docs, marks = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    good = quality.good_documents(docs, marks)
    assert good.columns == docs.columns
    scored = {r.doc_id for r in quality.quality(docs, marks).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == scored


def test_gradients():
    """The gradients of the attention model against differences."""
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    w = {"enc": rng.normal(0, .1, (quality.FEATURES, 5)), "enc0": rng.normal(0, .1, 5), "v": rng.normal(size=(5, 4)), "u": rng.normal(size=(5, 4)),
         "a": rng.normal(size=4), "c": rng.normal(size=5), "c0": np.array(0.1)}
    weight = np.array([1.0, 2.0, 0.5])

    def loss(p):
        q = quality.forward(p, x, first)["p"]
        return -(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / weight.sum()

    g = quality.gradients(w, x, first, y, weight)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k][at]) < 1e-6
