"""Flat rows for people: CSV files and sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill import rules, schemas
from lettermill.functions.dates import display_date
from lettermill.functions.text import head, or_default, or_empty


def percent_text(share: Column) -> Column:
    return F.concat(F.round(share.cast("double") * 100).cast("int").cast("string"), F.lit("%"))


def _common() -> dict[str, Column]:
    return {
        "date": display_date(or_empty(F.col("received_at"))),
        "company": or_empty(F.col("company_name")),
        "role": or_empty(F.col("role_title")),
        "source": or_empty(F.col("source")),
        "job_board": or_default(F.col("job_board"), rules.DEFAULT_BOARD),
        "subject": head(or_empty(F.col("raw_subject")), rules.DISPLAY_SUBJECT_CHARS),
        "event_id": or_empty(F.col("event_id")),
    }


def rejection_rows(enriched: DataFrame, names: Sequence[str] = schemas.REJECTION_COLUMNS) -> DataFrame:
    """Nine columns; pass the sheet titles as ``names`` for a sheet."""
    c = _common()
    label = or_default(F.col("rejection_type"), "unknown")
    share = percent_text(F.coalesce(F.col("confidence"), F.lit(0.0)))
    row = [
        c["date"], c["company"], c["role"], label, c["source"], c["job_board"], share,
        c["subject"], c["event_id"],
    ]
    return enriched.select(*[value.alias(name) for value, name in zip(row, names, strict=True)])


def application_rows(
    enriched: DataFrame, names: Sequence[str] = schemas.APPLICATION_COLUMNS
) -> DataFrame:
    """Eight columns; pass the sheet titles as ``names`` for a sheet."""
    c = _common()
    status = or_default(F.col("application_status"), rules.APPLICATION_STATUSES[0])
    row = [
        c["date"], c["company"], c["role"], status, c["source"], c["job_board"],
        c["subject"], c["event_id"],
    ]
    return enriched.select(*[value.alias(name) for value, name in zip(row, names, strict=True)])
