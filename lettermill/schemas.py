"""Declared schemas; nothing in the package infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])


# --- fixed values: field names and their order ------------------------------
BASE_FIELDS = [
    "event_id", "source", "raw_subject", "raw_body_text", "sender_email",
    "received_at", "ingested_at", "schema_version",
]
REJECTION_FIELDS = BASE_FIELDS + ["company_name", "role_title", "rejection_type"]
APPLICATION_FIELDS = BASE_FIELDS + [
    "company_name", "role_title", "job_board", "application_status", "job_posting_url",
]
DEAD_LETTER_FIELDS = [
    "dlq_event_id", "original_topic", "failure_reason", "raw_payload", "failed_at",
    "producer_name", "schema_version",
]
PAYLOAD_FIELDS = BASE_FIELDS + ["rejection_type", "application_status", "job_board"]
REJECTION_COLUMNS = [
    "date_received", "company", "role", "rejection_type", "source", "job_board",
    "confidence", "subject", "event_id",
]
APPLICATION_COLUMNS = [
    "date_applied", "company", "role", "status", "source", "job_board", "subject",
    "event_id",
]
REJECTION_TITLES = [
    "Date Received", "Company", "Role", "Rejection Type", "Source", "Job Board",
    "Confidence", "Subject", "Event ID",
]
APPLICATION_TITLES = [
    "Date Applied", "Company", "Role", "Status", "Source", "Job Board", "Subject",
    "Event ID",
]
# --- end of fixed values ----------------------------------------------------

PAYLOAD = _strings(*PAYLOAD_FIELDS)
DEAD_LETTER = _strings(*DEAD_LETTER_FIELDS)
LABELLED_TEXT = _strings("text", "label")

# The JSON lines a sink writes: the payload, what enrichment found, and when.
ENRICHED_FIELDS = PAYLOAD_FIELDS + ["company_name", "role_title"]
ENRICHED = T.StructType(
    list(_strings(*ENRICHED_FIELDS).fields)
    + [
        T.StructField("nlp_confidence", T.FloatType(), True),
        T.StructField("processed_at", T.StringType(), True),
    ]
)

# One record of a topic, the columns a Kafka source yields.
ENVELOPE = T.StructType(
    [
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType(), True),
                        T.StructField("value", T.BinaryType(), True),
                    ]
                )
            ),
            True,
        ),
    ]
)

# A message as a mail REST service returns it.
GRAPH_MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("subject", T.StringType(), True),
        T.StructField(
            "from", T.StructType([T.StructField("emailAddress", _strings("address"), True)]), True
        ),
        T.StructField("receivedDateTime", T.StringType(), True),
        T.StructField("body", _strings("contentType", "content"), True),
    ]
)

RAW_FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), True),
        T.StructField("content", T.BinaryType(), True),
    ]
)
