"""An e-mail view over the documents table, and topic records made from it.

Each document becomes one mail whose body ends with the document's whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.text import text_array
from lettermill.operators.classify import classify
from lettermill.operators.events import event_json, make_events, route

# --- fixed values: what the view is made of ---------------------------------
SUBJECTS = [
    "Update on your application at Northwind",
    "Application received - Data Scientist II",
    "Thank you for applying, Senior ML Engineer",
    "Your weekly newsletter",
    "Your candidacy for Platform Engineer",
    "Interview schedule",
    "Hello",
    "Re: Staff Software Engineer role",
    "Decision regarding your application",
    "Thanks for your time",
    "Your order has shipped",
]
BODIES = [
    "After careful consideration we will not be moving forward with your candidacy.",
    "We have received your application for the role.",
    "We will keep your resume on file and reach out for future opportunities.",
    "Unfortunately the position has been filled.",
    "Thank you for applying to Contoso. We've received your application for the Data Engineer position.",
    "We have chosen to pursue another candidate but would love to stay in touch.",
    "Your package is on its way.",
    "You applied to Full-Stack Engineer III. Your submission was successfully submitted.",
    "Thank you for your interest in our team.",
    "We'll reach out if a new SRE position opens.",
    "Lunch at noon?",
    "You were not selected for this opportunity.",
    "",
    "Thank you for your interest. You have applied already; the team will reply.",
]
SENDERS = [
    "hr@stripe.com",
    "Talent <jobs@linkedin.com>",
    "noreply@indeed.com",
    "no-reply@greenhouse.io",
    "no-reply@greenhouse-mail.io",
    "user@gmail.com",
    "hr@jobs.acme.com",
    "candice@fabrikam.co.uk",
    "x@clever.com",
    "a@wd5.myworkdayjobs.com",
    "careers@icims.com",
    "jobs@smartrecruiters.com",
    "team@ziprecruiter.com",
    "no-at-sign",
    "root@localhost",
    "Glassdoor <n@glassdoor.com>",
    "",
]
# Minutes wrap after ten years, so that any document id gives a four-digit year.
MINUTES = 5_256_000
INGESTED_AT = "2024-06-01T00:00:00.000000+00:00"
# --- end of fixed values ----------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], position: Column) -> Column:
    return F.element_at(text_array(values), (position % len(values) + 1).cast("int"))


def as_mails(documents: DataFrame, phrase_last: bool = False) -> DataFrame:
    """One mail for each document; ``phrase_last`` puts the body's phrase behind the text."""
    uid = F.col("doc_id")
    body = [_pick(BODIES, uid * 5), F.lit(" "), F.col("text")]
    minutes = (uid % MINUTES).cast("int")
    received = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(mins=minutes)
    return documents.select(
        uid,
        F.when(uid % 2 == 0, "gmail").otherwise("outlook").alias("source"),
        _pick(SUBJECTS, uid).alias("subject"),
        F.concat(*(reversed(body) if phrase_last else body)).alias("body"),
        _pick(SENDERS, uid * 3).alias("sender"),
        F.concat(F.replace(received.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00")).alias(
            "received_at"
        ),
        (uid % 3 == 0).alias("is_read"),
    )


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_mails(table(spark, sf_dir, "documents").select("doc_id", "text"))


def late_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mail with the deciding phrase at the end, which a reading window misses."""
    return as_mails(table(spark, sf_dir, "documents").select("doc_id", "text"), phrase_last=True)


def published(all_mails: DataFrame) -> DataFrame:
    """The events of all mail that is not unrelated."""
    return make_events(route(classify(all_mails)), ingested_at=F.lit(INGESTED_AT))


def records(all_mails: DataFrame) -> DataFrame:
    """Topic records of the routed mail; some payloads are broken, empty or missing."""
    routed = route(classify(all_mails))
    events = make_events(
        routed.select("topic", "doc_id", "source", "subject", "body", "sender", "received_at"),
        ingested_at=F.lit(INGESTED_AT),
        event_id=F.col("doc_id").cast("string"),
    )
    number = F.col("event_id").cast("long")
    state = number % 10
    value = (
        F.when(state == 7, F.lit("not json"))
        .when(state == 8, F.lit(""))
        .when(state == 9, F.lit(None))
        .otherwise(event_json(F.col("topic")))
    )
    return events.select(
        "topic",
        F.col("source").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(0).alias("partition"),
        number.alias("offset"),
    )
