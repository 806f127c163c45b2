"""Choosing how rejection mail is labelled.

A labeller adds a label column from a text column, in steps: whatever several
expressions need is a column of its own, so it is worked out once per row.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions.extract import rejection_type
from lettermill.functions.scoring import top_label, unless_blank
from lettermill.functions.text import any_pattern, first_words, text_array

log = logging.getLogger(__name__)

RULES, SCORED, FITTED = "rules", "scored", "fitted"
BACKENDS = (RULES, SCORED, FITTED)
OLDER_NAMES = {"zero_shot": SCORED, "finetuned": FITTED}

Labeller = Callable[[DataFrame, str, str], DataFrame]
Scorer = Callable[[DataFrame, str, str], DataFrame]


def backend_name(given: str | None) -> str:
    """A known backend, also by its older name; anything else means rules, with a warning."""
    name = (given or "").strip().lower()
    name = OLDER_NAMES.get(name, name)
    if name and name not in BACKENDS:
        log.warning("no backend is called %r, using rules", given)
    return name if name in BACKENDS else RULES


def label_by_rules(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, rejection_type(F.col(text)))


def pattern_scores(df: DataFrame, text: str, out: str) -> DataFrame:
    """A stand-in scorer that needs no weights: each label's share of pattern hits.

    One vote always goes to unknown, so a text without hits scores 1 for it.
    """
    def hits(patterns: Sequence[str]) -> Column:
        return reduce(add, [F.col(text).rlike(any_pattern([p])).cast("int") for p in patterns])

    votes = df.withColumns(
        {
            "__hard": hits(rules.HARD_REJECTION_PATTERNS),
            "__soft": hits(rules.SOFT_REJECTION_PATTERNS),
        }
    )
    total = F.col("__hard") + F.col("__soft") + F.lit(1)
    shares = F.array(F.col("__hard") / total, F.col("__soft") / total, F.lit(1) / total)
    return votes.withColumn(out, shares).drop("__hard", "__soft")


def column_scorer(score: Callable[[Column], Column]) -> Scorer:
    """A scorer from a column function, such as a Python model's."""
    return lambda df, text, out: df.withColumn(out, score(F.col(text)))


def label_by_scores(
    scorer: Scorer = pattern_scores,
    labels: Sequence[str] = tuple(rules.REJECTION_LABELS),
    threshold: float = rules.LABEL_THRESHOLD,
    words: int | None = None,
    score: str | None = None,
) -> Labeller:
    """A labeller from a scorer, which adds one score per label in label order.

    The scorer sees the words of the text (the first ``words`` if given), and null
    for blank text, which is labelled unknown. ``score`` names a column for the best
    label's score, null for blank text.
    """
    def label(df: DataFrame, text: str, out: str) -> DataFrame:
        short = F.nullif(first_words(F.col(text), words), F.lit(""))
        scored = scorer(df.withColumn("__short", short), "__short", "__scores")
        best = top_label(text_array(labels), F.col("__scores"), threshold)
        found = {out: unless_blank(F.col("__short"), best)}
        if score is not None:
            found[score] = F.array_max("__scores")
        return scored.withColumns(found).drop("__short", "__scores")

    return label


def labeller_for(
    backend: str,
    model_path: str | None = None,
    scorer: Scorer = pattern_scores,
    threshold: float = rules.LABEL_THRESHOLD,
) -> Labeller:
    """The labeller of a backend; a fitted one without a saved model uses scores."""
    from lettermill.models.fitted import apply_model, load_model, model_exists

    if backend not in BACKENDS:
        raise ValueError(f"backend must be one of {BACKENDS}, got {backend!r}")
    if backend == RULES:
        return label_by_rules
    by_scores = label_by_scores(scorer, threshold=threshold)
    if backend == SCORED:
        return by_scores

    def fitted(df: DataFrame, text: str, out: str) -> DataFrame:
        if model_path is None or not model_exists(df.sparkSession, model_path):
            log.warning("no model at %s, using scored labels", model_path)
            return by_scores(df, text, out)
        return apply_model(load_model(model_path), df, text, out, threshold)

    return fitted
