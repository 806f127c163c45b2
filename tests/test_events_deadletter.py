from __future__ import annotations

import json

from pyspark.sql import functions as F

from lettermill import rules, schemas
from lettermill.operators import deadletter as dl
from lettermill.operators import events as ev
from lettermill.operators.classify import classify
from lettermill.sources.topics import (
    kafka_read_options,
    kafka_write_options,
    read_topic_files,
    write_topic_files,
)
from tests.conftest import plan_of

MAIL = "source string, subject string, sender string, received_at string, body string"
ROWS = [
    ("gmail", "Unfortunately — für \"Sie\"", "a@x.com", "2025-06-01T10:00:00+00:00", "the job\nline"),
    ("outlook", "Application received", "jobs@indeed.com", "2025-06-01T10:00:00+00:00", "role"),
    ("outlook", "Hello", "b@x.com", "2025-06-01T10:00:00+00:00", "lunch"),
]


def published(spark):
    return ev.make_events(ev.route(classify(spark.createDataFrame(ROWS, MAIL))))


def test_envelopes(spark):
    rows = {r["topic"]: r for r in ev.to_envelopes(published(spark)).collect()}
    assert set(rows) == {rules.TOPIC_REJECTIONS, rules.TOPIC_APPLICATIONS}
    rejection = json.loads(rows[rules.TOPIC_REJECTIONS]["value"])
    application = json.loads(rows[rules.TOPIC_APPLICATIONS]["value"])
    assert list(rejection) == schemas.REJECTION_FIELDS
    assert list(application) == schemas.APPLICATION_FIELDS
    assert rejection["raw_subject"] == ROWS[0][1] and rejection["rejection_type"] == "unknown"
    assert "für" in bytes(rows[rules.TOPIC_REJECTIONS]["value"]).decode()
    assert application["application_status"] == "applied" and application["job_board"] == "Indeed"
    assert bytes(rows[rules.TOPIC_REJECTIONS]["key"]) == b"gmail"
    headers = {h["key"]: bytes(h["value"]).decode() for h in rows[rules.TOPIC_REJECTIONS]["headers"]}
    assert headers == {"schema_version": "1.0", "source": "gmail"}


def test_ids_follow_the_content(spark):
    first, again = (sorted(r["event_id"] for r in published(spark).collect()) for _ in range(2))
    assert first == again and len(set(first)) == 2
    other = published(spark).withColumn("event_id", ev.random_id())
    assert sorted(r["event_id"] for r in other.collect()) != first


def test_now_is_utc_text(spark):
    df = spark.range(1).select(ev.utc_now().alias("now"), F.unix_micros(F.current_timestamp()).alias("t"))
    row = df.first()
    assert row["now"].endswith("+00:00") and len(row["now"]) == 32


def test_category_is_worked_out_once(spark):
    """A filter on the topic must not bring the phrase tests along."""
    df = published(spark).filter(F.col("topic") == rules.TOPIC_REJECTIONS)
    filters = [line for line in plan_of(df).splitlines() if " Filter " in line or "DataFilters" in line]
    assert filters and not any("candidacy" in line for line in filters)
    assert "Python" not in plan_of(df)


PAYLOADS = [
    (rules.TOPIC_REJECTIONS, b'{"event_id":"1","raw_subject":"s","extra":1}'),
    (rules.TOPIC_REJECTIONS, b'{"event_id":2,"raw_subject":null}'),
    (rules.TOPIC_APPLICATIONS, b'{"event_id":"3","raw_subject":{"a":[1]}}'),
    (rules.TOPIC_REJECTIONS, b"not json"),
    (rules.TOPIC_APPLICATIONS, b"[1]"),
    (rules.TOPIC_APPLICATIONS, b""),
    (rules.TOPIC_REJECTIONS, b"  "),
    (rules.TOPIC_REJECTIONS, None),
    (rules.TOPIC_APPLICATIONS, b'{"event_id":"9"' + b" " * 200 + b"}"),
    (rules.TOPIC_REJECTIONS, b"bad \xff utf"),
]


def parsed(spark, max_bytes=100):
    rows = [(t, v, 0, i) for i, (t, v) in enumerate(PAYLOADS)]
    df = spark.createDataFrame(rows, "topic string, value binary, partition int, offset long")
    return dl.parse_payloads(df, max_bytes=max_bytes)


def test_split(spark):
    reasons = [r["failure_reason"] for r in parsed(spark).orderBy("offset").collect()]
    assert reasons == [
        None, None, None, dl.MALFORMED, dl.MALFORMED, dl.EMPTY_PAYLOAD, dl.EMPTY_PAYLOAD,
        dl.NULL_PAYLOAD, dl.OVERSIZE, dl.MALFORMED,
    ]
    good = {r["event_id"]: r for r in dl.good_events(parsed(spark)).collect()}
    assert set(good) == {"1", "2", "3"}
    assert good["3"]["raw_subject"] == '{"a":[1]}' and good["1"]["topic"] == rules.TOPIC_REJECTIONS
    assert good["1"].asDict().keys() == {"topic", *schemas.PAYLOAD_FIELDS}


def test_dead_letters(spark):
    letters = dl.dead_letters(parsed(spark), "p").collect()
    assert len(letters) == 7 and len({r["dlq_event_id"] for r in letters}) == 7
    by_payload = {r["raw_payload"]: r for r in letters}
    assert by_payload["not json"]["topic"] == rules.TOPIC_DLQ_REJECTIONS
    assert by_payload["[1]"]["topic"] == rules.TOPIC_DLQ_APPLICATIONS
    assert "bad � utf" in by_payload
    assert by_payload["not json"]["producer_name"] == "p"
    counts = {
        (r["original_topic"], r["failure_reason"]): r["letters"]
        for r in dl.audit(dl.dead_letters(parsed(spark), "p")).collect()
    }
    assert counts[(rules.TOPIC_REJECTIONS, dl.MALFORMED)] == 2


def test_dead_letter_records(spark):
    rows = dl.dead_letter_json(dl.dead_letters(parsed(spark), "p")).collect()
    assert {bytes(r["key"]) for r in rows} == {b"dlq"}
    assert list(json.loads(rows[0]["value"])) == schemas.DEAD_LETTER_FIELDS


def test_replay(spark):
    letters = dl.dead_letters(parsed(spark), "p")
    again = dl.parse_payloads(dl.replay(letters, reasons=[dl.OVERSIZE]))
    assert [r["event_id"] for r in dl.good_events(again).collect()] == ["9"]
    assert dl.replay(letters, topics=[rules.TOPIC_APPLICATIONS]).count() == 3
    assert dl.replay(letters).count() == 7


def test_limit_of_five_mebibytes_when_asked_for(spark):
    rows = [(rules.TOPIC_REJECTIONS, b"x" * n) for n in (rules.MAX_MESSAGE_BYTES, rules.MAX_MESSAGE_BYTES + 1)]
    df = spark.createDataFrame(rows, "topic string, value binary")
    limited = dl.parse_payloads(df, max_bytes=rules.MAX_MESSAGE_BYTES)
    assert {r["failure_reason"] for r in limited.select("failure_reason").collect()} == {
        dl.MALFORMED, dl.OVERSIZE,
    }
    assert {r["failure_reason"] for r in dl.parse_payloads(df).select("failure_reason").collect()} == {dl.MALFORMED}


def test_records_a_broker_refuses(spark):
    rows = [("t", b"k", b"abc"), ("t", None, b"abc"), ("t", b"k", b"abcd"), ("t", b"k", None)]
    df = spark.createDataFrame(rows, "topic string, key binary, value binary")
    assert [r["refusal"] for r in dl.refused(df, 3).collect()] == [None, dl.NULL_KEY, dl.OVERSIZE, None]
    assert [r["refusal"] for r in dl.refused(df, None).collect()] == [None, dl.NULL_KEY, None, None]


def test_topic_files(spark, tmp_path):
    path = str(tmp_path / "topics")
    write_topic_files(ev.to_envelopes(published(spark)), path)
    back = read_topic_files(spark, path, rules.TOPIC_REJECTIONS)
    assert back.columns == [c for c in schemas.ENVELOPE.names if c != "topic"] + ["topic"] or set(
        back.columns
    ) == set(schemas.ENVELOPE.names)
    assert back.count() == 1 and read_topic_files(spark, path).count() == 2
    assert dl.good_events(dl.parse_payloads(back)).first()["raw_subject"] == ROWS[0][1]


def test_kafka_options():
    read = kafka_read_options("h:9092", "t")
    assert read["startingOffsets"] == "latest" and read["failOnDataLoss"] == "false"
    assert kafka_read_options("h:9092", "t", earliest=True)["startingOffsets"] == "earliest"
    write = kafka_write_options("h:9092", **{"kafka.linger.ms": "5"})
    assert write["kafka.acks"] == "all" and write["kafka.compression.type"] == "lz4"
    assert write["kafka.linger.ms"] == "5"


def test_source_order(spark, tmp_path):
    """One source holds nearly all rows: it still spreads over partitions, in order."""
    rows = [("gmail" if i % 50 else "outlook", f"{(i * 7919) % 5000:05d}") for i in range(5000)]
    df = spark.createDataFrame(rows, "source string, received_at string")
    ordered = ev.order_by_source(df, "received_at", partitions=8)
    parts = ordered.withColumn("p", F.spark_partition_id()).collect()
    assert len({r["p"] for r in parts if r["source"] == "gmail"}) >= 6
    for source in ("gmail", "outlook"):
        times = [r["received_at"] for r in parts if r["source"] == source]
        assert times == sorted(times)
