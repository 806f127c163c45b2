"""The gate that tells rejections, applications and unrelated mail apart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions.text import contains_any, count_contained, head, or_empty, pin

REJECTION, APPLICATION, UNRELATED = rules.CATEGORIES


@dataclass(frozen=True)
class GateRules:
    context: Sequence[str] = tuple(rules.JOB_CONTEXT_TERMS)
    rejection_subjects: Sequence[str] = tuple(rules.STRONG_REJECTION_SUBJECTS)
    application_subjects: Sequence[str] = tuple(rules.STRONG_APPLICATION_SUBJECTS)
    rejection_phrases: Sequence[str] = tuple(rules.REJECTION_PHRASES)
    application_phrases: Sequence[str] = tuple(rules.APPLICATION_PHRASES)


def _decide(rejection: Column, application: Column) -> Column:
    return (
        F.when((rejection == 0) & (application == 0), UNRELATED)
        .when(rejection >= application, REJECTION)
        .otherwise(APPLICATION)
    )


def classify(
    mails: DataFrame,
    subject: str = "subject",
    body: str = "body",
    body_chars: int | None = None,
    gate: GateRules = GateRules(),
    with_scores: bool = False,
) -> DataFrame:
    """Add ``category``, and the evidence for it when ``with_scores`` is set.

    The text to search is built once in an inner projection, and the category is
    pinned, so that filters on it cost nothing twice. Without the scores phrases
    are counted only for mail that the cheaper tests leave open.
    """
    lowered = mails.select("*", F.lower(or_empty(F.col(subject))).alias("__subject"))
    preview = F.lower(head(or_empty(F.col(body)), body_chars))
    texts = lowered.select("*", F.concat("__subject", F.lit(" "), preview).alias("__text"))
    title, text = F.col("__subject"), F.col("__text")

    evidence = {
        "has_context": contains_any(text, gate.context),
        "strong_rejection": contains_any(title, gate.rejection_subjects),
        "strong_application": contains_any(title, gate.application_subjects),
        "rejection_score": count_contained(text, gate.rejection_phrases),
        "application_score": count_contained(text, gate.application_phrases),
    }
    if with_scores:
        texts = texts.select("*", *[value.alias(name) for name, value in evidence.items()])
        found = {name: F.col(name) for name in evidence}
        by_score = _decide(found["rejection_score"], found["application_score"])
    else:
        found = evidence
        counts = F.array(
            F.struct(
                evidence["rejection_score"].alias("r"), evidence["application_score"].alias("a")
            )
        )
        by_score = F.element_at(F.transform(counts, lambda s: _decide(s["r"], s["a"])), 1)

    category = (
        F.when(~found["has_context"], UNRELATED)
        .when(found["strong_rejection"], REJECTION)
        .when(found["strong_application"], APPLICATION)
        .otherwise(by_score)
    )
    return pin(texts, "category", category).drop("__subject", "__text")


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count(F.lit(1)).alias("mails"))
