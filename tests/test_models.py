from __future__ import annotations

import logging

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.models import backends
from lettermill.models.fitted import (
    TRAIN_SHARE, apply_model, load_model, model_exists, save_model, split_rows, train,
)
from lettermill.models.plugin import model_column
from lettermill.operators.enrich import enrich
from lettermill.session import work_dir

TEXTS = {
    "hard_rejection": "We will not be moving forward with your application number {}",
    "soft_rejection": "We will keep your resume on file for openings of round {}",
    "unknown": "Thank you for your time during the interview on day {}",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(text.format(i), label) for label, text in TEXTS.items() for i in range(80)]
    return spark.createDataFrame([*rows, ("x", "odd")], "text string, label string")


@pytest.fixture(scope="module")
def saved(spark, labelled):
    model, losses = train(labelled, epochs=3, steps_per_epoch=5, features=1024)
    path = work_dir(spark, "model")
    save_model(model, path)
    return path, losses


def labels(spark, labeller, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["label"] for r in labeller(df, "text", "label").orderBy("i").collect()]


def test_fitted(spark, saved):
    path, losses = saved
    assert len(losses) == 3 and min(losses) < 0.5
    labeller = backends.labeller_for("fitted", path)
    found = labels(spark, labeller, [t.format(999) for t in TEXTS.values()] + ["  \n", None])
    assert found == [*TEXTS, "unknown", "unknown"]


def test_threshold(spark, saved):
    df = spark.createDataFrame([(TEXTS["hard_rejection"].format(1),)], "text string")
    row = apply_model(load_model(saved[0]), df, threshold=1.01, score="score").first()
    assert row["label"] == "unknown" and 0.5 < row["score"] <= 1


def test_split_is_stable(spark, labelled):
    a, b = split_rows(labelled, TRAIN_SHARE, "text")
    assert a.count() + b.count() == labelled.count()
    again, _ = split_rows(labelled.repartition(7), TRAIN_SHARE, "text")
    assert sorted(r["text"] for r in a.collect()) == sorted(r["text"] for r in again.collect())
    assert 0.75 < a.count() / labelled.count() < 0.95


def test_missing_model_falls_back_to_scores(spark, caplog):
    assert not model_exists(spark, "/nonexistent/path")
    labeller = backends.labeller_for("fitted", "/nonexistent/path")
    with caplog.at_level(logging.WARNING):
        found = labels(spark, labeller, ["You were not selected", "hello"])
    assert found == ["hard_rejection", "unknown"] and "no model" in caplog.text


def test_backend_names():
    assert [backends.backend_name(x) for x in (None, "", " Scored ", "FITTED", "spam")] == [
        "rules", "rules", "scored", "fitted", "rules",
    ]
    assert [backends.backend_name(x) for x in ("zero_shot", "Finetuned")] == ["scored", "fitted"]
    with pytest.raises(ValueError):
        backends.labeller_for("other")


def test_all_backends_share_one_contract(spark, saved):
    text = "We will not be moving forward with your application"
    for name in backends.BACKENDS:
        assert labels(spark, backends.labeller_for(name, saved[0]), [text]) == ["hard_rejection"]


def python_scorer(seen_words=None):
    def score(model, texts):
        rows = [model(t) for t in texts]
        return pd.DataFrame({"labels": [rules.REJECTION_LABELS] * len(rows), "scores": rows})

    def load():
        return lambda text: [0.0, 0.0, 0.0] if text is None else [
            0.55, 0.01 * min(len(text.split()), 45), 0.15]

    return model_column(load, score, "struct<labels:array<string>,scores:array<double>>")


def test_python_scorer_sees_400_words_and_no_blank_text(spark):
    udf = python_scorer()
    scorer = backends.column_scorer(lambda text: udf(text)["scores"])
    texts = ["word " * 600, "   \n ", "few words"]
    assert labels(spark, backends.label_by_scores(scorer), texts) == [
        "hard_rejection", "unknown", "hard_rejection",
    ]
    assert labels(spark, backends.label_by_scores(scorer, threshold=0.9), texts) == ["unknown"] * 3
    seen = []
    probe = backends.column_scorer(lambda text: seen.append(text) or F.array(*[F.size(F.split(text, " ")).cast("double")] * 3))
    df = spark.createDataFrame([("word " * 600,)], "text string")
    scored = probe(df.withColumn("t", F.lit(" ".join(["w"] * 400))), "t", "s").first()
    assert scored["s"][0] == 400


def test_entity_model_plugs_into_enrichment(spark):
    def load():
        return {"Airbnb", "Initech"}

    def find(model, texts):
        return texts.map(lambda t: [w for w in t.split() if w in model])

    orgs = model_column(load, find, "array<string>")
    df = spark.createDataFrame(
        [("Initech and Airbnb", "b", "a@x.com"), ("none", "b", "a@stripe.com")],
        "raw_subject string, raw_body_text string, sender_email string",
    ).withColumn("orgs", orgs("raw_subject"))
    names = [r["company_name"] for r in enrich(df, "rejection", candidates="orgs").collect()]
    assert names == ["Initech", "Stripe"]


def test_labeller_is_used_by_enrichment(spark):
    df = spark.createDataFrame(
        [("s", "not selected, another candidate, stay in touch", "", "rejection"), ("s", "not selected", "", "application")],
        "raw_subject string, raw_body_text string, sender_email string, kind string",
    )
    out = enrich(df, F.col("kind"), labeller=backends.labeller_for("scored"))
    assert [r["rejection_type"] for r in out.collect()] == ["hard_rejection", "n/a"]
    assert not [c for c in out.columns if c.startswith("__")]


def test_bayes_equals_the_plain_rule(spark, tmp_path):
    import math
    from collections import Counter

    from lettermill.models.bayes import apply_bayes, save_bayes, train_bayes

    rows = [("not selected not", "hard_rejection"), ("keep in touch", "soft_rejection"), ("not now, touch", "soft_rejection"),
            (None, "hard_rejection"), ("spam", "other label"), ("x", None)]
    texts = ["not selected", "touch keep", "new words", "", None, "not selected"]
    model = save_bayes(train_bayes(spark.createDataFrame(rows, "text string, label string")), str(tmp_path / "bayes"))
    found = apply_bayes(model, spark.createDataFrame([(t, "kept") for t in texts], "text string, note string")).collect()
    counts = {y: Counter(w for t, z in rows if z == y for w in (t or "").replace(",", "").split()) for y in ("hard_rejection", "soft_rejection")}
    v = len({w for c in counts.values() for w in c})

    def chances(text):
        logs = {y: math.log(0.5) + sum(math.log((c[w] + 1) / (c.total() + v)) for w in (text or "").split()) for y, c in counts.items()}
        return {y: math.exp(x) / sum(math.exp(z) for z in logs.values()) for y, x in logs.items()}

    for row in found:
        expected = chances(row["text"])
        assert row["score"] == pytest.approx(max(expected.values())) and row["note"] == "kept"
        assert row["label"] == (max(expected, key=expected.get) if row["text"] else "unknown")
    assert len(found) == len(texts)
    empty = train_bayes(spark.createDataFrame([], "text string, label string"))
    assert [r["label"] for r in apply_bayes(empty, spark.createDataFrame([("a",)], "text string")).collect()] == ["unknown"]


@pytest.mark.parametrize("bounds", [{"broadcast_rows": rows} for rows in (0, 1, 20, 500)])
def test_bayes_gives_the_same_whatever_is_broadcast(spark, bounds):
    from lettermill.models.bayes import apply_bayes, train_bayes

    # Word w<k> is in every k-th mail, x<i> in one; one word is too long to be broadcast early.
    mails = [" ".join(f"w{k}" for k in range(1, 60) if i % k == 0) + f" x{i}, w1 w1" for i in range(300)]
    mails += ["", " \t", None, "new words only", "y" * 100, mails[7], mails[7]]
    labels = ["hard_rejection", "soft_rejection"]
    df = spark.createDataFrame([(i, t, labels[i % 2]) for i, t in enumerate(mails)], "i int, text string, label string")
    model, texts = train_bayes(df), df.select("i", "text")
    texts = texts.union(spark.createDataFrame([(-1, "w1 never trained, never")], texts.schema))
    expected = {r["i"]: r for r in apply_bayes(model, texts).collect()}
    found = {r["i"]: r for r in apply_bayes(model, texts, **bounds).collect()}
    assert len(found) == len(mails) + 1 and found.keys() == expected.keys()
    for i, row in found.items():
        assert row["text"] == expected[i]["text"] and row["label"] == expected[i]["label"]
        assert row["score"] == pytest.approx(expected[i]["score"])


def shuffled_bytes(df) -> int:
    """Bytes of all rows that the shuffles of a query that ran have sent."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        elif node.nodeName() == "Exchange":
            total += node.metrics().get("dataSize").get().value()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return total


@pytest.mark.parametrize("rows", [70, 1_000_000])
def test_bayes_sends_less_than_the_texts(spark, rows):
    """Frequent words stay where they are when the vocabulary is too long to be broadcast whole, and so do texts."""
    from lettermill.models.bayes import apply_bayes, train_bayes

    mails = [" ".join(f"frequent{(i + k) % 64}" for k in range(400)) + f" x{i}" for i in range(200)]
    df = spark.createDataFrame([(i, t, "hard_rejection") for i, t in enumerate(mails)], "i int, text string, label string")
    found = apply_bayes(train_bayes(df), df.select("i", "text"), broadcast_rows=rows).select("i", "label", "score")
    assert len(found.collect()) == len(mails)
    assert 0 < shuffled_bytes(found) < sum(map(len, mails)) / 4
