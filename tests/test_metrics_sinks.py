from __future__ import annotations

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lettermill import schemas
from lettermill.operators import display, metrics
from lettermill.sinks import files
from lettermill.sinks.metrics import write_batch_metrics
from lettermill.sources.files import count_lines, read_labelled, split_known_labels

# A known batch, whose metrics are known.
BATCH = [
    ("Stripe", "SWE", "hard_rejection", 0.9),
    ("Airbnb", "ML Eng", "soft_rejection", 0.6),
    ("", "", "unknown", 0.2),
]
FIELDS = "company_name string, role_title string, rejection_type string, confidence double"


def batch(spark, rows=BATCH, event_type="rejection", batch_id=0):
    df = spark.createDataFrame(rows, FIELDS)
    return df.withColumns(
        {"batch_id": F.lit(batch_id).cast("long"), "backend": F.lit("rules"), "event_type": F.lit(event_type)}
    )


def test_batch_metrics(spark):
    row = metrics.batch_metrics(batch(spark), latency_seconds=F.lit(3.0)).first()
    assert row["batch_size"] == 3
    assert row["avg_confidence"] == pytest.approx(1.7 / 3)
    assert (row["min_confidence"], row["max_confidence"]) == (0.2, 0.9)
    assert row["company_extraction_rate"] == pytest.approx(2 / 3)
    assert row["role_extraction_rate"] == pytest.approx(2 / 3)
    assert row["throughput_events_per_sec"] == pytest.approx(1.0)


def test_missing_values_count_as_nothing_found(spark):
    row = metrics.batch_metrics(batch(spark, [(None, None, None, None), ("a", "b", "x", 0.8)])).first()
    assert (row["avg_confidence"], row["min_confidence"]) == (0.4, 0.0)
    assert row["company_extraction_rate"] == 0.5


def test_empty_batch_gives_no_row(spark):
    assert metrics.batch_metrics(batch(spark, [])).count() == 0
    assert metrics.label_distribution(batch(spark, [])).count() == 0


def test_instant_batch(spark):
    row = metrics.batch_metrics(batch(spark), latency_seconds=F.lit(0.0)).first()
    assert row["throughput_events_per_sec"] == pytest.approx(3000)


def test_label_distribution(spark):
    rows = [("", "", "hard rejection", 0.0)] * 3 + [("", "", None, 0.0)]
    both = batch(spark, rows).unionByName(batch(spark, BATCH, batch_id=1))
    found = {(r["batch_id"], r["label"]): (r["label_count"], r["label_pct"]) for r in metrics.label_distribution(both).collect()}
    assert found[(0, "hard_rejection")] == (3, 0.75) and found[(0, "n/a")] == (1, 0.25)
    assert found[(1, "unknown")] == (1, pytest.approx(1 / 3))


def test_metric_rows(spark):
    rows = metrics.metric_rows(
        metrics.batch_metrics(batch(spark)), metrics.label_distribution(batch(spark))
    ).collect()
    values = {r["key"]: r["value"] for r in rows}
    assert values["batch_size"] == 3 and values["label_count_unknown"] == 1
    assert values["label_pct_hard_rejection"] == pytest.approx(1 / 3)
    assert {r["event_type"] for r in rows} == {"rejection"}


def test_backend_comparison(spark):
    rows = [("rules", 0.7), ("rules", 0.8), ("scored", 0.85), ("scored", 0.9)]
    df = spark.createDataFrame(rows, "backend string, confidence double")
    found = {r["backend"]: (r["avg_confidence"], r["sample_size"]) for r in metrics.backend_comparison(df).collect()}
    assert found == {"rules": (pytest.approx(0.75), 2), "scored": (pytest.approx(0.875), 2)}


def test_output_summary_counts_absent_kinds(spark):
    df = spark.createDataFrame([("rejection",), ("rejection",)], "event_type string")
    found = {r["event_type"]: r["rows"] for r in metrics.output_summary(df).collect()}
    assert found == {"rejection": 2, "application": 0}


EVENT = {
    "event_id": "test-123",
    "source": "gmail",
    "raw_subject": 'Update, "quoted" ' + "x" * 200,
    "raw_body_text": "We will not be moving forward.\nBye",
    "sender_email": "hr@stripe.com",
    "received_at": "2025-06-01T10:00:00+00:00",
    "ingested_at": "2025-06-01T10:01:00+00:00",
    "schema_version": "1.0",
    "rejection_type": "hard_rejection",
    "application_status": None,
    "job_board": "LinkedIn",
    "company_name": "Stripe",
    "role_title": "",
    "confidence": 0.8,
    "payload_rejection_type": "unknown",
}


def event(spark, **changes):
    row = {**EVENT, **changes}
    schema = ", ".join(f"{k} {'float' if k == 'confidence' else 'string'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_rejection_row(spark):
    row = display.rejection_rows(event(spark)).first()
    assert row.asDict() == {
        "date_received": "2025-06-01 10:00 UTC", "company": "Stripe", "role": "",
        "rejection_type": "hard_rejection", "source": "gmail", "job_board": "LinkedIn",
        "confidence": "80%", "subject": EVENT["raw_subject"][:120], "event_id": "test-123",
    }
    titled = display.rejection_rows(event(spark), schemas.REJECTION_TITLES)
    assert titled.columns == schemas.REJECTION_TITLES


@pytest.mark.parametrize("status,shown", [(None, "applied"), ("", "applied"), ("offer", "offer")])
def test_application_row(spark, status, shown):
    row = display.application_rows(event(spark, application_status=status, job_board=None)).first()
    assert row["status"] == shown and row["job_board"] == "company_direct"
    assert list(row.asDict()) == schemas.APPLICATION_COLUMNS


def test_percent(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)], "c float")
    assert [r[0] for r in df.select(display.percent_text(F.col("c"))).collect()] == [
        f"{x}%" for x in (0, 20, 40, 60, 80, 100)
    ]


def lines(path, pattern="part-*"):
    return [
        line for f in sorted(Path(path).rglob(pattern)) for line in f.read_text().splitlines()
    ]


def test_json_lines(spark, tmp_path):
    out = str(tmp_path)
    stamp = F.lit("now")
    for kind in ("rejection", "application"):
        files.write_json_lines(files.json_records(event(spark), kind, stamp), out, kind, 0)
    record = json.loads(lines(tmp_path / "rejections")[0])
    assert list(record) == [*schemas.ENRICHED_FIELDS, "nlp_confidence", "processed_at"]
    assert record["rejection_type"] == "hard_rejection" and record["nlp_confidence"] == 0.8
    assert record["application_status"] is None
    assert json.loads(lines(tmp_path / "applications")[0])["rejection_type"] == "unknown"
    assert files.read_json_lines(spark, out, "rejection").first()["company_name"] == "Stripe"


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    out = str(tmp_path)
    assert files.output_counts(spark, out) == {"rejections": 0, "applications": 0}
    records = files.json_records(event(spark), "rejection", F.lit("now"))
    for batch_id in (0, 1, 1, 2):
        files.write_json_lines(records, out, "rejection", batch_id)
    assert files.output_counts(spark, out) == {"rejections": 3, "applications": 0}


def test_csv_reads_back(spark, tmp_path):
    files.write_csv(files.summary_rows(event(spark), "rejection"), str(tmp_path), "rejection", 0)
    parts = [
        list(csv.reader(f.open(newline=""))) for f in (tmp_path / "rejections" / "csv").rglob("part-*")
    ]
    # Every part file has the header, one without rows too.
    assert all(part[0] == schemas.REJECTION_COLUMNS for part in parts)
    (row,) = [row for part in parts for row in part[1:]]
    assert row[2] == "" and row[7] == EVENT["raw_subject"][:120]


def test_metrics_sink_never_raises(spark, tmp_path):
    assert write_batch_metrics(batch(spark), str(tmp_path), "rules", "rejection", 4, 2.5)
    rows = spark.read.parquet(str(tmp_path / "metrics")).collect()
    assert {r["batch_id"] for r in rows} == {4}
    assert {r["key"]: r["value"] for r in rows}["batch_latency_seconds"] == 2.5
    (tmp_path / "file").write_text("in the way")
    assert not write_batch_metrics(batch(spark), str(tmp_path / "file"), "rules", "rejection", 0, 1.0)


def test_labelled_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text(
        '{"text":"a","label":"unknown"}\n{"text":"b","label":"odd"}\n{"text":"c"}\n'
    )
    known, rest = split_known_labels(read_labelled(spark, str(tmp_path)))
    assert [r["text"] for r in known.collect()] == ["a"]
    assert sorted(r["text"] for r in rest.collect()) == ["b", "c"]
    assert count_lines(spark, str(tmp_path)) == 3 and count_lines(spark, str(tmp_path / "none")) == 0
