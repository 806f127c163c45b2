"""Company, role, kind of rejection, board and confidence as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions import extract
from lettermill.functions.text import or_empty

NOT_APPLICABLE = "n/a"
REJECTION, APPLICATION = "rejection", "application"


def enrich(
    events: DataFrame,
    event_type: str | Column,
    subject: str = "raw_subject",
    body: str = "raw_body_text",
    sender: str = "sender_email",
    body_chars: int | None = None,
    candidates: str | None = None,
    labeller: Callable[[DataFrame, str, str], DataFrame] | None = None,
    guard_empty: bool = True,
) -> DataFrame:
    """Add ``company_name, role_title, rejection_type, job_board, confidence``.

    ``event_type`` is one kind for the whole table or a column, so that a mixed
    table is read once. ``candidates`` names an array column of organisation
    names in text order; without it, or with none usable, the sender's domain
    names the company. ``labeller`` adds a rejection label from a text column;
    the default is the pattern rules, and applications are never labelled. An
    event with neither subject nor body gets the defaults unless
    ``guard_empty`` is off.
    """
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    is_rejection = F.col("__kind") == REJECTION
    empty = (or_empty(F.col(subject)) == "") & (or_empty(F.col(body)) == "")
    texts = events.select(
        "*",
        extract.mail_text(F.col(subject), F.col(body), body_chars).alias("__text"),
        kind.alias("__kind"),
        (empty & F.lit(guard_empty)).alias("__empty"),
    )
    text = F.col("__text")
    company = extract.sender_company(F.col(sender))
    if candidates:
        named = extract.first_entity(F.col(candidates))
        company = F.coalesce(F.nullif(named, F.lit("")), company)
    if isinstance(event_type, str) and event_type == APPLICATION:
        label = F.lit(NOT_APPLICABLE)
    elif labeller is None:
        label = F.when(is_rejection, extract.rejection_type(text)).otherwise(NOT_APPLICABLE)
    else:
        texts = labeller(
            texts.withColumn("__labelled", F.when(is_rejection, text)), "__labelled", "__label"
        ).drop("__labelled")
        label = F.when(is_rejection, F.col("__label")).otherwise(NOT_APPLICABLE)

    def unless_empty(default: str, value: Column) -> Column:
        return F.when(F.col("__empty"), F.lit(default)).otherwise(value)

    found = texts.drop("company_name", "role_title", "rejection_type", "job_board").select(
        "*",
        unless_empty("", company).alias("company_name"),
        unless_empty("", extract.role_title(text)).alias("role_title"),
        F.when(F.col("__empty"), F.when(is_rejection, "unknown").otherwise(NOT_APPLICABLE))
        .otherwise(label)
        .alias("rejection_type"),
        unless_empty(rules.DEFAULT_BOARD, extract.job_board(F.col(sender))).alias("job_board"),
    )
    score = extract.confidence(F.col("company_name"), F.col("role_title"), F.col("job_board"))
    return found.select("*", score.alias("confidence")).drop(
        "__text", "__kind", "__empty", "__label"
    )
