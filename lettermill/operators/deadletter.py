"""Reading topic payloads, setting bad ones aside and reading them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill import rules, schemas
from lettermill.functions.text import or_empty, pin
from lettermill.operators.events import DLQ_OF_TOPIC, content_id, utc_now

NULL_KEY = "null key"
NULL_PAYLOAD, EMPTY_PAYLOAD, OVERSIZE, MALFORMED = (
    "null payload", "empty payload", "oversize", "malformed json",
)
_CORRUPT = "_corrupt"


def parse_payloads(
    envelopes: DataFrame,
    schema: T.StructType = schemas.PAYLOAD,
    max_bytes: int | None = None,
) -> DataFrame:
    """Add ``payload`` (text), ``event`` (struct) and ``failure_reason`` (null if good).

    With ``max_bytes`` longer payloads are set aside unread, as a broker would.
    ``from_json`` gives an all-null struct for null and empty text without
    calling it corrupt, so both are told apart here.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType(), True)])
    value = F.col("value").cast("binary")
    too_long = F.lit(False) if max_bytes is None else F.octet_length(value) > max_bytes
    sized = envelopes.select(
        "*",
        F.make_valid_utf8(F.col("value").cast("string")).alias("payload"),
        too_long.alias("__oversize"),
    )
    parsed = sized.select(
        "*",
        F.when(
            ~F.col("__oversize"),
            F.from_json(
                "payload",
                with_corrupt,
                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
            ),
        ).alias("__event"),
    )
    reason = (
        F.when(F.col("payload").isNull(), NULL_PAYLOAD)
        .when(F.col("__oversize"), OVERSIZE)
        .when(F.trim("payload") == "", EMPTY_PAYLOAD)
        .when(F.col(f"__event.{_CORRUPT}").isNotNull() | F.col("__event").isNull(), MALFORMED)
    )
    fields = F.struct(*[F.col(f"__event.{name}").alias(name) for name in schema.names])
    return pin(parsed.select("*", fields.alias("event")), "failure_reason", reason).drop(
        "__event", "__oversize"
    )


def good_events(parsed: DataFrame) -> DataFrame:
    """The events of readable payloads, one column per field, with their topic."""
    readable = F.when(F.col("failure_reason").isNull(), F.array("event"))
    return parsed.select("topic", F.inline(readable))


def dead_letters(
    parsed: DataFrame, producer_name: str, failed_at: Column | None = None
) -> DataFrame:
    """Unreadable payloads as dead letters, with the dead-letter topic of each."""
    bad = parsed.filter(F.col("failure_reason").isNotNull())
    return to_dead_letters(
        bad, F.col("topic"), F.col("failure_reason"), F.col("payload"), producer_name, failed_at
    )


def to_dead_letters(
    df: DataFrame,
    original_topic: Column,
    reason: Column,
    payload: Column,
    producer_name: str,
    failed_at: Column | None = None,
) -> DataFrame:
    values = {
        "dlq_event_id": content_id(original_topic, reason, payload, *_coordinates(df)),
        "original_topic": original_topic,
        "failure_reason": reason,
        "raw_payload": or_empty(payload),
        "failed_at": utc_now() if failed_at is None else failed_at,
        "producer_name": F.lit(producer_name),
        "schema_version": F.lit(rules.SCHEMA_VERSION),
    }
    dlq_topic = F.lit(None).cast("string")
    for topic, target in DLQ_OF_TOPIC.items():
        dlq_topic = F.when(original_topic == topic, F.lit(target)).otherwise(dlq_topic)
    return df.select(
        *[value.alias(name) for name, value in values.items()], dlq_topic.alias("topic")
    )


def refused(records: DataFrame, max_bytes: int | None = rules.MAX_MESSAGE_BYTES) -> DataFrame:
    """Records with ``refusal``: why a broker would not take them, else null."""
    too_long = F.lit(False) if max_bytes is None else F.octet_length("value") > max_bytes
    reason = F.when(F.col("key").isNull(), NULL_KEY).when(too_long, OVERSIZE)
    return pin(records, "refusal", reason)


def _coordinates(df: DataFrame) -> list[Column]:
    """Where in its topic a record lies, when known: tells equal payloads apart."""
    return [F.col(c).cast("string") for c in ("partition", "offset") if c in df.columns]


def dead_letter_json(letters: DataFrame) -> DataFrame:
    """Dead letters as topic records, keyed alike."""
    as_json = F.to_json(F.struct(*schemas.DEAD_LETTER_FIELDS), {"ignoreNullFields": "false"})
    return letters.select(
        "topic", F.lit("dlq").cast("binary").alias("key"), as_json.cast("binary").alias("value")
    )


def audit(letters: DataFrame) -> DataFrame:
    """Dead letters per topic and reason."""
    return letters.groupBy("original_topic", "failure_reason").agg(
        F.count(F.lit(1)).alias("letters")
    )


def replay(
    letters: DataFrame,
    reasons: Sequence[str] | None = None,
    topics: Sequence[str] | None = None,
) -> DataFrame:
    """Dead letters back as topic records, ready for ``parse_payloads``."""
    if reasons is not None:
        letters = letters.filter(F.col("failure_reason").isin(*reasons))
    if topics is not None:
        letters = letters.filter(F.col("original_topic").isin(*topics))
    return letters.select(
        F.col("original_topic").alias("topic"), F.col("raw_payload").cast("binary").alias("value")
    )
