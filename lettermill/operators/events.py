"""Typed events, their JSON and the topic each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill import rules, schemas
from lettermill.functions.extract import job_board
from lettermill.functions.text import or_empty

TOPIC_OF_CATEGORY = {
    "rejection": rules.TOPIC_REJECTIONS,
    "application": rules.TOPIC_APPLICATIONS,
}
DLQ_OF_TOPIC = {
    rules.TOPIC_REJECTIONS: rules.TOPIC_DLQ_REJECTIONS,
    rules.TOPIC_APPLICATIONS: rules.TOPIC_DLQ_APPLICATIONS,
}


def content_id(*columns: Column) -> Column:
    """An id that is the same whenever the same content is read again.

    A random id would change when a lost task runs a second time, and could
    not recognise a mail that is fetched twice.
    """
    return F.sha2(F.concat_ws("\x1f", *[or_empty(c) for c in columns]), 256)


def random_id() -> Column:
    return F.uuid()


def utc_now() -> Column:
    """The start of the query as ISO-8601 text in UTC."""
    stamp = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def topic_of(category: Column) -> Column:
    """The topic of a category; null for mail that is not published."""
    topic = F.lit(None).cast("string")
    for name, target in TOPIC_OF_CATEGORY.items():
        topic = F.when(category == name, F.lit(target)).otherwise(topic)
    return topic


def route(classified: DataFrame) -> DataFrame:
    """Add ``topic`` and drop unrelated mail, in one pass over the mail."""
    return classified.withColumn("topic", topic_of(F.col("category"))).filter(
        F.col("topic").isNotNull()
    )


def make_events(
    routed: DataFrame,
    event_id: Column | None = None,
    ingested_at: Column | None = None,
    ingest_board: Column | None = None,
) -> DataFrame:
    """Routed mail as events: the base fields and both kinds' extra fields.

    ``ingest_board`` is what the ingest side already knows of the job board;
    by default only the second mailbox kind looks it up.
    """
    mail = [F.col(c) for c in ("source", "subject", "sender", "received_at", "body")]
    if ingest_board is None:
        ingest_board = F.when(
            F.col("source") == "outlook", job_board(F.col("sender"), rules.INGEST_JOB_BOARDS)
        ).otherwise("")
    values = {
        "event_id": content_id(*mail) if event_id is None else event_id,
        "source": F.col("source"),
        "raw_subject": F.col("subject"),
        "raw_body_text": F.col("body"),
        "sender_email": F.col("sender"),
        "received_at": F.col("received_at"),
        "ingested_at": utc_now() if ingested_at is None else ingested_at,
        "schema_version": F.lit(rules.SCHEMA_VERSION),
        "company_name": F.lit(""),
        "role_title": F.lit(""),
        "rejection_type": F.lit("unknown"),
        "job_board": ingest_board,
        "application_status": F.lit(rules.APPLICATION_STATUSES[0]),
        "job_posting_url": F.lit(""),
    }
    return routed.select("topic", *[value.alias(name) for name, value in values.items()])


def event_json(topic: Column) -> Column:
    """The JSON of an event, with the fields of its topic's kind."""
    def as_json(fields: list[str]) -> Column:
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    return F.when(topic == rules.TOPIC_REJECTIONS, as_json(schemas.REJECTION_FIELDS)).otherwise(
        as_json(schemas.APPLICATION_FIELDS)
    )


def to_envelopes(events: DataFrame) -> DataFrame:
    """Events as keyed topic records: the source is the key."""
    headers = F.array(
        *[
            F.struct(F.lit(name).alias("key"), F.col(column).cast("binary").alias("value"))
            for name, column in (("schema_version", "schema_version"), ("source", "source"))
        ]
    )
    return events.select(
        "topic",
        F.col("source").cast("binary").alias("key"),
        event_json(F.col("topic")).cast("binary").alias("value"),
        headers.alias("headers"),
    )


def order_by_source(events: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Each source's events in order, spread over many partitions.

    Partitions are ranges of (source, order), so one busy source fills many of
    them, and a source's events read partition after partition stay in order.
    Finding the ranges reads the input once more: hand over a stored table.
    """
    keys = ["source", *order]
    ranged = (
        events.repartitionByRange(*keys)
        if partitions is None
        else events.repartitionByRange(partitions, *keys)
    )
    return ranged.sortWithinPartitions(*keys)
