from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lettermill.operators.enrich import enrich

SCHEMA = "raw_subject string, raw_body_text string, sender_email string"


def one(spark, subject, body, sender, kind="rejection", **options):
    df = spark.createDataFrame([(subject, body, sender)], SCHEMA)
    return enrich(df, kind, **options).first()


def test_rejection(spark):
    row = one(
        spark,
        "Update on your application — Software Engineer at Stripe",
        "After careful consideration we will not be moving forward with your candidacy.",
        "hr@stripe.com",
    )
    assert row["rejection_type"] == "hard_rejection"
    assert row["role_title"] == "Software Engineer"
    assert row["company_name"] == "Stripe"
    assert row["confidence"] == pytest.approx(0.8)


def test_application_has_no_rejection_type(spark):
    row = one(
        spark,
        "Application received — Data Scientist at Airbnb",
        "Thank you for applying to Airbnb. We've received your application.",
        "jobs@greenhouse.io",
        "application",
    )
    assert (row["rejection_type"], row["job_board"]) == ("n/a", "Greenhouse")
    assert row["confidence"] == pytest.approx(1.0)


def test_empty_mail(spark):
    row = one(spark, "", None, "hr@stripe.com")
    assert (row["company_name"], row["role_title"], row["rejection_type"]) == ("", "", "unknown")
    assert (row["job_board"], row["confidence"]) == ("company_direct", 0.0)
    assert one(spark, "", "", "hr@stripe.com", "application")["rejection_type"] == "n/a"
    unguarded = one(spark, "", "", "hr@stripe.com", guard_empty=False)
    assert unguarded["company_name"] == "Stripe"


def test_candidates_come_before_the_sender(spark):
    df = spark.createDataFrame(
        [("s", "b", "hr@stripe.com", ["LinkedIn", "Acme"]), ("s", "b", "hr@stripe.com", ["the"])],
        SCHEMA + ", orgs array<string>",
    )
    names = [r["company_name"] for r in enrich(df, "rejection", candidates="orgs").collect()]
    assert names == ["Acme", "Stripe"]


def test_kind_as_a_column(spark):
    df = spark.createDataFrame(
        [("not selected", "", "", "rejection"), ("not selected", "", "", "application")],
        SCHEMA + ", kind string",
    )
    labels = [r["rejection_type"] for r in enrich(df, F.col("kind")).collect()]
    assert labels == ["hard_rejection", "n/a"]


def test_window_of_600_characters(spark):
    body = "x" * 596 + " SRE"
    assert one(spark, "s", body, "", body_chars=600)["role_title"] == "SRE"
    assert one(spark, "s", "x" + body, "", body_chars=600)["role_title"] == ""
    assert one(spark, "s", "x" + body, "")["role_title"] == "SRE"


def test_payload_columns_are_replaced(spark):
    df = spark.createDataFrame(
        [("s", "not selected", "a@dice.com", "soft_rejection", "Lever")],
        SCHEMA + ", rejection_type string, job_board string",
    )
    row = enrich(df, "rejection").first()
    assert (row["rejection_type"], row["job_board"]) == ("hard_rejection", "Dice")
