from __future__ import annotations

import numpy as np
import pytest

from lettermill.llm import quality, queries, toxicity
from lettermill.llm.samples import labelled_sample
from tests.llm.helpers import DOCS, ODD, documents, held_out, labels_of, rows_of

LABELS = "doc_id long, label int"


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def test_quality_separates_held_out_documents(spark, larger):
    labels = labels_of(larger, "quality")
    rows = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, larger).collect()}
    assert len(rows) == 10_000
    of = {k: [rows[i]["keep"] for i, y in labels.items() if held_out(i) and y == k] for k in (0, 1)}
    assert np.mean(of[1]) > 0.99 and np.mean(of[0]) < 0.08
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected"] <= 2 for r in rows.values())


def test_toxicity_separates_held_out_documents(spark, larger):
    labels = labels_of(larger, "toxic")
    rows = {r["doc_id"]: r for r in queries.op5_toxicity(spark, larger).collect()}
    assert len(rows) == 10_000
    assert all(r["held_out"] == held_out(i) and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    found = {k: [rows[i]["predicted"] for i, y in labels.items() if held_out(i) and y == k] for k in (0, 1)}
    assert np.mean(found[1]) > 0.85 and np.mean(found[0]) < 0.02


def test_ordinal_gradient_and_order():
    draw = np.random.default_rng(0)
    rows = [(np.array([0, 1], np.int32), np.array([x, 1.0], np.float32)) for x in draw.normal(size=600)]
    grades = np.array([0 if r[1][0] < -0.5 else 1 if r[1][0] < 0.5 else 2 for r in rows])
    model = quality.fit_ordinal(rows, grades, 3, epochs=60)
    assert model.thresholds[0] < model.thresholds[1]
    score = np.array([model.weights[s] @ v for s, v in rows])
    tails = model.tails(score)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails.sum(1)).round() == grades) > 0.85


def test_word_weights_add_up_to_the_features():
    draw = np.random.default_rng(1)
    weights = draw.normal(size=quality.SLOTS)
    for text in ("", "one", "Der Der Der 12 !!", "A b%%% c\n\nd e " * 30):
        slots, values = quality.features(text)
        assert quality.score_texts(weights)([text])[0] == pytest.approx(float(weights[slots] @ values), abs=1e-4)


def plain_factor_score(model, text: str) -> float:
    rows = [model.table[[r for r in map(model.rows.get, toxicity.term_slots(t)) if r]].sum(0) for t in toxicity.terms(text)]
    total = model.bias + sum(r[0] for r in rows)
    for a in range(len(rows)):
        for b in range(a):
            total += rows[a][1:] @ rows[b][1:]
    return 1 / (1 + np.exp(-total))


def test_pairs_are_learned_that_single_terms_miss():
    draw = np.random.default_rng(2)
    texts, labels = [], []
    for _ in range(1200):
        insult, group = draw.random(2) < 0.5
        words = [f"w{k}" for k in draw.integers(0, 40, 6)] + ["insult"] * int(insult) + ["group"] * int(group)
        texts.append(" ".join(words))
        labels.append(float(insult and group))
    rows = {s: k for k, s in enumerate(sorted({s for t in texts[:900] for w in toxicity.terms(t) for s in toxicity.term_slots(w)}), 1)}
    model = toxicity.fit_factors([toxicity.pack_text(t, rows) for t in texts[:900]], np.array(labels[:900]), rows, epochs=30)
    score = toxicity.score_texts(model, remembered=20)
    assert np.mean((score(texts[900:]) >= 0.5) == np.array(labels[900:])) > 0.97
    for text in texts[900:910]:
        assert score([text])[0] == pytest.approx(plain_factor_score(model, text), abs=1e-4)
    pair = score(["insult group", "insult", "group", "plain words"])
    assert pair[0] > 0.5 > max(pair[1:])


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(300)] + [(1, "again"), (None, "x")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400)] + [(1, 1), (1, None), (None, 1)], LABELS)
    rows = labelled_sample(docs, labels, 1000).collect()
    assert sorted(r["doc_id"] for r in rows) == [k for k in range(300) if not held_out(k)]
    assert labelled_sample(docs, labels, 17).count() == 17


@pytest.mark.parametrize("labels", [[], [(5, 1)], [(5, 0), (6, 1), (7, 1), (4, 0)]])
def test_odd_rows(spark, labels):
    docs = documents(spark, [*ODD, *[(k, f"some words {k}") for k in range(40, 60)]], "score")
    rated = spark.createDataFrame(labels, LABELS)
    model = quality.fit_quality(docs, rated, 3)
    scores = quality.quality_scores(docs, model)
    assert scores.columns == ["doc_id", "expected", "tail", "keep"] and scores.count() == docs.count()
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == scores.filter("keep").count()
    found = rows_of(toxicity.toxicity(docs, toxicity.fit_toxicity(docs, rated)))
    assert len(found) == docs.count() and all(0 <= r[2] <= 1 for r in found)
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(empty, model).count() == 0
    assert toxicity.toxicity(empty, toxicity.fit_toxicity(empty, rated)).count() == 0
