from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lettermill import rules
from lettermill.operators.classify import GateRules, category_counts, classify

# Known mail and the category it must get.
CASES = [
    ("Update on your application at Acme Corp",
     "After careful consideration, we have decided not to move forward with your candidacy.",
     "rejection"),
    ("Application received — Senior Data Engineer at Stripe",
     "Thank you for applying to Stripe. We've received your application for the Senior Data "
     "Engineer role.", "application"),
    ("Your Amazon order has shipped", "Your package is on its way. Track it here.", "unrelated"),
    ("Thank you for your interest",
     "We appreciate you taking the time to apply. Unfortunately, we will not be moving forward "
     "with your application at this time.", "rejection"),
    # A tie goes to rejection; a lone weak phrase counts.
    ("Hello", "Unfortunately we saw your submission for the role", "rejection"),
    ("Hello", "thank you for your interest in the team", "rejection"),
    # Context without any phrase, and empty or missing text.
    ("Interview schedule", "See you on Monday", "unrelated"),
    ("", "", "unrelated"),
    (None, None, "unrelated"),
    (None, "your submission for the position", "application"),
    # A strong subject needs job context, which the subject itself may give.
    ("UNFORTUNATELY", "no relation", "unrelated"),
    ("UNFORTUNATELY", "no role", "rejection"),
    # Rejection subjects are tried before application subjects.
    ("Application received - update on your application", "", "rejection"),
]


def categories(spark, rows, **options):
    df = spark.createDataFrame(
        [(i, s, b) for i, (s, b) in enumerate(rows)], "i int, subject string, body string"
    )
    return [r["category"] for r in classify(df, **options).orderBy("i").collect()]


def test_known_mail(spark):
    assert categories(spark, [c[:2] for c in CASES]) == [c[2] for c in CASES]


def test_scores_do_not_change_the_category(spark):
    assert categories(spark, [c[:2] for c in CASES], with_scores=True) == [c[2] for c in CASES]


def test_nested_phrases_count_twice_and_repeats_once(spark):
    df = spark.createDataFrame(
        [("s", "we will keep your resume on file. keep your resume on file")],
        "subject string, body string",
    )
    row = classify(df, with_scores=True).first()
    assert row["rejection_score"] == 2


def test_window_ends_after_1000_characters(spark):
    edge = "é" * 985
    rows = [("x", edge + "your submission"), ("x", edge + " your submission")]
    job = [(s, "job " + b[4:]) for s, b in rows]
    assert categories(spark, job, body_chars=1000) == ["application", "unrelated"]
    assert categories(spark, job) == ["application", "application"]


def test_other_lexicon(spark):
    gate = GateRules(context=["cat"], rejection_phrases=["no cats"], application_phrases=["yes"])
    assert categories(spark, [("", "no cats"), ("", "cat yes"), ("", "dog")], gate=gate) == [
        "rejection", "application", "unrelated",
    ]


def test_counts(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "subject string, body string")
    counted = {r["category"]: r["mails"] for r in category_counts(classify(df)).collect()}
    assert counted == {"rejection": 6, "application": 2, "unrelated": 5}


def plain_category(subject: str, body: str) -> str:
    """The rules once more, as plain Python over one mail."""
    title = subject.lower()
    text = title + " " + body[:1000].lower()
    if all(t not in text for t in rules.JOB_CONTEXT_TERMS):
        return "unrelated"
    if any(p in title for p in rules.STRONG_REJECTION_SUBJECTS):
        return "rejection"
    if any(p in title for p in rules.STRONG_APPLICATION_SUBJECTS):
        return "application"
    no, yes = (
        len([p for p in phrases if p in text])
        for phrases in (rules.REJECTION_PHRASES, rules.APPLICATION_PHRASES)
    )
    return "unrelated" if no + yes == 0 else "rejection" if no >= yes else "application"


PIECES = st.sampled_from(
    rules.REJECTION_PHRASES
    + rules.APPLICATION_PHRASES
    + rules.JOB_CONTEXT_TERMS
    + rules.STRONG_REJECTION_SUBJECTS
    + rules.STRONG_APPLICATION_SUBJECTS
    + [" ", ". ", "é", "Σ", "ß", "x" * 300, "\n"]
)
TEXT = st.lists(PIECES, max_size=6).map(" ".join).flatmap(
    lambda t: st.sampled_from([t, t.upper(), t.title()])
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXT, TEXT), min_size=50, max_size=100))
def test_agrees_with_plain_rules(spark, rows):
    assert categories(spark, rows) == [plain_category(s, b) for s, b in rows]


@pytest.mark.parametrize("phrases", [[], ["a"]])
def test_short_lexicons(spark, phrases):
    gate = GateRules(rejection_phrases=phrases, application_phrases=[])
    assert categories(spark, [("job", "a")], gate=gate) == [
        "rejection" if phrases else "unrelated"
    ]
