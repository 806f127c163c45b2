from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.operators.deadletter import parse_payloads
from lettermill.plans.mails import mails, published, records
from lettermill.session import work_dir
from lettermill.sinks import files
from lettermill.sources.topics import read_topic_files, stream_topic_files, write_topic_files
from lettermill.streaming.ingest import Ingest
from lettermill.streaming.jobs import poll_message_files, train_from_files
from lettermill.streaming.pipeline import (
    Pipeline,
    batch_seconds,
    dedup_stream,
    drain,
    read_dead_letters,
    run,
)

STAMP = "2024-06-01T00:00:00+00:00"


@pytest.fixture(scope="module")
def topics(spark, sf_dir):
    path = work_dir(spark, "topics")
    write_topic_files(records(mails(spark, sf_dir)).repartition(6), path)
    return path


def streams(spark, topics, max_files=None):
    return {
        t: stream_topic_files(spark, topics, t, max_files)
        for t in (rules.TOPIC_REJECTIONS, rules.TOPIC_APPLICATIONS)
    }


def json_rows(spark, out):
    columns = ["event_id", "company_name", "role_title", "rejection_type", "job_board", "processed_at"]
    return sorted(
        tuple(str(v) for v in r)
        for kind in files.FOLDERS
        for r in files.read_json_lines(spark, out, kind).select(*columns).collect()
    )


def test_many_batches_equal_one(spark, topics, sf_dir):
    parsed = parse_payloads(records(mails(spark, sf_dir)))
    good = parsed.filter("failure_reason IS NULL").count()
    outs = []
    for max_files in (None, 2):
        out = work_dir(spark, "out")
        counts = drain(
            spark, Pipeline(out, processed_at=STAMP), streams(spark, topics, max_files), work_dir(spark, "cp")
        )
        assert sum(counts.values()) == good
        outs.append(out)
    assert json_rows(spark, outs[0]) == json_rows(spark, outs[1])
    batches = files.read_json_lines(spark, outs[1], "rejection").select("batch_id").distinct().count()
    assert batches >= 3
    letters = read_dead_letters(spark, outs[1])
    assert letters.count() == parsed.filter("failure_reason IS NOT NULL").count()
    assert letters.select("dlq_event_id").distinct().count() == letters.count()


def test_a_repeated_batch_replaces_its_output(spark, topics):
    """The sinks ran but the commit was lost: the batch comes again."""
    out = work_dir(spark, "out")
    pipeline = Pipeline(out, processed_at=STAMP)
    batch = spark.read.schema("key binary, value binary, partition int, offset long").parquet(
        f"{topics}/topic={rules.TOPIC_REJECTIONS}"
    ).withColumn("topic", F.lit(rules.TOPIC_REJECTIONS))
    pipeline.handle(batch, 7, "rejection")
    once, letters = files.output_counts(spark, out), read_dead_letters(spark, out).count()
    pipeline.handle(batch, 7, "rejection")
    assert files.output_counts(spark, out) == once and once["rejections"] > 0
    assert read_dead_letters(spark, out).count() == letters


def test_restart_goes_on_where_it_stopped(spark, sf_dir):
    path, out, checkpoint = (work_dir(spark, n) for n in ("topics", "out", "cp"))
    all_records = records(mails(spark, sf_dir))
    totals = []
    for part in (0, 1):
        write_topic_files(all_records.filter(F.col("offset") % 2 == part), path)
        pipeline = Pipeline(out, processed_at=STAMP)
        totals.append(sum(drain(spark, pipeline, streams(spark, path), checkpoint).values()))
    good = parse_payloads(all_records).filter("failure_reason IS NULL").count()
    assert 0 < totals[0] < totals[1] == good


def test_failing_second_sink_is_skipped(spark, topics):
    out = work_dir(spark, "out")

    def broken(df, kind, batch_id, run_id):
        raise RuntimeError("sheet is down")

    pipeline = Pipeline(out, processed_at=STAMP, second_sink=broken)
    assert sum(drain(spark, pipeline, streams(spark, topics), work_dir(spark, "cp")).values()) > 0
    assert pipeline.failures and "sheet is down" in pipeline.failures[0]


def test_empty_batch_writes_nothing(spark, topics):
    out = work_dir(spark, "out")
    empty = spark.createDataFrame([], "value binary, topic string")
    Pipeline(out).handle(empty, 0, "rejection")
    assert files.output_counts(spark, out) == {"rejections": 0, "applications": 0}


def test_run_waits_and_reports(spark, topics):
    out = work_dir(spark, "out")
    pipeline = Pipeline(out, processed_at=STAMP)
    started = [
        pipeline.start(records, "rejection", work_dir(spark, "cp"), every="1 second")
        for records in [streams(spark, topics)[rules.TOPIC_REJECTIONS]]
    ]
    started[0].processAllAvailable()
    assert batch_seconds(started[0]) > 0
    started[0].stop()
    assert run(spark, started, out)["rejections"] > 0
    assert not started[0].isActive


def test_run_ends_with_its_query(spark, topics):
    out = work_dir(spark, "out")
    stream = streams(spark, topics)[rules.TOPIC_APPLICATIONS]
    query = Pipeline(out, processed_at=STAMP).start(stream, "application", work_dir(spark, "cp"), None)
    assert run(spark, [query], out)["applications"] > 0


@pytest.mark.parametrize("spread", [None, "offset"])
def test_dedup(spark, spread):
    """One event has most of the copies; two events have unreadable dates."""
    path, out = work_dir(spark, "in"), work_dir(spark, "out")
    rows = [("a", "2025-06-01T10:00:00Z"), ("a", "2025-06-01T10:05:00Z"), ("b", "someday"), ("b", "")]
    rows += [("hot", f"2025-06-01T10:{i % 30:02d}:00Z") for i in range(300)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "event_id string, received_at string, offset long")
    df.withColumn("ingested_at", F.lit("2025-06-01T10:00:00Z")).repartition(4).write.parquet(path)
    stream = (
        spark.readStream.schema("event_id string, received_at string, offset long, ingested_at string")
        .option("maxFilesPerTrigger", 2).parquet(path)
    )
    kept = dedup_stream(stream, spread=None if spread is None else F.col(spread), salts=4)
    (
        kept.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", work_dir(spark, "cp")).trigger(availableNow=True).start()
    ).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "hot"]


def ingest_into(spark, publish_dir, processed):
    return Ingest(
        lambda records, batch_id: write_topic_files(records, f"{publish_dir}/batch={batch_id}"), processed
    )


def topic_count(spark, publish_dir):
    return spark.read.schema("value binary").option("recursiveFileLookup", "true").parquet(publish_dir).count()


def test_ingest_publishes_each_mail_once(spark, sf_dir):
    path, out, processed, checkpoint = (work_dir(spark, n) for n in ("mail", "pub", "seen", "cp"))
    flat = mails(spark, sf_dir).withColumnRenamed("doc_id", "uid").drop("is_read")
    expected = published(mails(spark, sf_dir)).count()
    # The second half overlaps the first, and repeats some mail within itself.
    for low, high in ((0, 120), (80, 10_000)):
        part = flat.filter(F.col("uid").between(low, high))
        part.unionByName(part.filter("uid % 5 = 0")).write.mode("append").parquet(path)
        stream = spark.readStream.schema(flat.schema).parquet(path)
        ingest_into(spark, out, processed).poll(stream, checkpoint, every=None).awaitTermination()
    assert topic_count(spark, out) == expected
    ids = spark.read.parquet(processed)
    assert ids.count() == ids.select("uid").distinct().count() == flat.count()


def test_ingest_keeps_its_ids_when_a_batch_repeats(spark, sf_dir):
    out, processed = work_dir(spark, "pub"), work_dir(spark, "seen")
    flat = mails(spark, sf_dir).withColumnRenamed("doc_id", "uid").drop("is_read")
    job = ingest_into(spark, out, processed)
    for _ in range(2):
        job.handle(flat, 3)
    assert spark.read.parquet(processed).count() == flat.count()
    before = topic_count(spark, out)
    job.handle(flat, 4)
    assert topic_count(spark, out) == before


def test_mail_without_a_date_is_published_once(spark):
    out, processed = work_dir(spark, "pub"), work_dir(spark, "seen")
    rows = [(str(i), "gmail", "not selected for a job", "a@x.com", d, "") for i, d in enumerate([None, "", "someday", "2025"])]
    df = spark.createDataFrame(
        rows, "uid string, source string, subject string, sender string, received_at string, body string"
    )
    for batch_id in (0, 1):
        ingest_into(spark, out, processed).handle(df, batch_id)
        assert topic_count(spark, out) == len(rows)


def test_unreadable_mail_becomes_a_dead_letter(spark):
    out = work_dir(spark, "pub")
    rows = [("1", "gmail", "not selected for a job", "a@x.com", "", "", None), ("2", None, None, None, None, None, "LookupError: x")]
    df = spark.createDataFrame(
        rows, "uid string, source string, subject string, sender string, received_at string, body string, error string"
    )
    ingest_into(spark, out, work_dir(spark, "seen")).handle(df, 0)
    found = spark.read.parquet(f"{out}/batch=0").groupBy("topic").count().collect()
    assert {r["topic"]: r["count"] for r in found} == {rules.TOPIC_REJECTIONS: 1, rules.TOPIC_DLQ_REJECTIONS: 1}


def test_staged_batches_equal_cached_ones(spark, topics):
    outs = []
    for stage in (None, work_dir(spark, "stage")):
        outs.append(work_dir(spark, "out"))
        drain(spark, Pipeline(outs[-1], processed_at=STAMP, stage_dir=stage), streams(spark, topics), work_dir(spark, "cp"))
    assert json_rows(spark, outs[0]) == json_rows(spark, outs[1]) != []


def test_backfill_from_the_topic_table(spark, topics):
    out = work_dir(spark, "out")
    Pipeline(out, processed_at=STAMP).handle(
        read_topic_files(spark, topics, rules.TOPIC_REJECTIONS), 0, "rejection"
    )
    streamed = work_dir(spark, "out")
    drain(spark, Pipeline(streamed, processed_at=STAMP), streams(spark, topics), work_dir(spark, "cp"))
    assert files.output_counts(spark, out)["rejections"] == files.output_counts(spark, streamed)["rejections"]


def test_a_new_checkpoint_adds_to_earlier_output(spark, sf_dir):
    out = work_dir(spark, "out")
    all_records = records(mails(spark, sf_dir))
    totals = []
    for part in (0, 1):
        path = work_dir(spark, "topics")
        write_topic_files(all_records.filter(F.col("offset") % 2 == part), path)
        totals.append(sum(drain(spark, Pipeline(out, processed_at=STAMP), streams(spark, path), work_dir(spark, "cp")).values()))
    good = parse_payloads(all_records).filter("failure_reason IS NULL").count()
    assert 0 < totals[0] < totals[1] == good


def test_ids_of_other_runs_are_kept(spark, sf_dir):
    out, processed = work_dir(spark, "pub"), work_dir(spark, "seen")
    flat = mails(spark, sf_dir).withColumnRenamed("doc_id", "uid").drop("is_read")

    def handle(part):
        # Every job is a run of its own, and each begins with batch 0.
        name = work_dir(spark, "publish")
        Ingest(lambda records, _: write_topic_files(records, f"{out}/{name[-8:]}"), processed).handle(part, 0)

    handle(flat.filter("uid < 100"))
    handle(flat.filter("uid >= 100"))
    before = topic_count(spark, out)
    assert spark.read.parquet(processed).count() == flat.count()
    handle(flat)
    assert topic_count(spark, out) == before == published(mails(spark, sf_dir)).count()


def test_mail_without_an_id_is_never_merged(spark):
    out, processed = work_dir(spark, "pub"), work_dir(spark, "seen")
    rows = [(None, "gmail", f"not selected for a job {i}", "a@x.com", "2025", "") for i in range(3)]
    df = spark.createDataFrame(rows, "uid string, source string, subject string, sender string, received_at string, body string")
    ingest_into(spark, out, processed).handle(df, 0)
    assert topic_count(spark, out) == 3


def test_a_future_date_makes_no_other_mail_late(spark):
    path, out = work_dir(spark, "in"), work_dir(spark, "out")
    rows = [("a", "2099-01-01T00:00:00Z"), ("spam", "2099-01-01T00:00:00Z"), ("b", "2025-01-01T00:00:00Z"),
            ("c", "2025-01-02T00:00:00Z"), ("b", "2025-01-01T00:00:00Z"), (None, "2025"), (None, "2025")]
    schema = "event_id string, received_at string"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    (
        dedup_stream(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", work_dir(spark, "cp")).trigger(availableNow=True).start()
    ).awaitTermination()
    assert sorted(str(r["event_id"]) for r in spark.read.parquet(out).collect()) == ["None", "None", "a", "b", "c", "spam"]


def test_polling_message_files_with_a_refused_record(spark, tmp_path):
    folder, out, processed = tmp_path / "mail", work_dir(spark, "pub"), work_dir(spark, "seen")
    folder.mkdir()
    for name, body in (("a", "short"), ("b", "long " * 500)):
        head = "From: hr@x.com\nSubject: not selected for the job\nDate: Sun, 1 Jun 2025 10:00:00 +0000\n\n"
        (folder / f"{name}.eml").write_text(head + body)
    publish = lambda records, _: write_topic_files(records, out)
    poll_message_files(spark, str(folder), publish, processed, work_dir(spark, "cp"), None, max_bytes=1000).awaitTermination()
    topics = {r["topic"]: r["count"] for r in spark.read.parquet(out).groupBy("topic").count().collect()}
    assert topics == {rules.TOPIC_REJECTIONS: 1, rules.TOPIC_DLQ_REJECTIONS: 1}


def test_built_in_sheet_sink(spark, topics):
    out, sheets = work_dir(spark, "out"), work_dir(spark, "sheets")
    pipeline = Pipeline(out, processed_at=STAMP, second_sink=files.sheet_sink(sheets))
    counts = drain(spark, pipeline, streams(spark, topics), work_dir(spark, "cp"))
    assert spark.read.parquet(f"{sheets}/rejections/sheet").count() == counts["rejections"] > 0


def test_training_job(spark, tmp_path):
    lines = [json.dumps({"text": f"not selected {i}" if i % 2 else f"stay in touch {i}",
                         "label": "hard_rejection" if i % 2 else "soft_rejection"}) for i in range(80)]
    (tmp_path / "data.jsonl").write_text("\n".join(lines))
    losses = train_from_files(spark, str(tmp_path / "data.jsonl"), str(tmp_path / "model"), epochs=1)
    assert len(losses) == 1 and (tmp_path / "model" / "metadata").exists()
