from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lettermill import rules, schemas, storage
from lettermill.operators import audit
from lettermill.plans.mails import mails, records
from lettermill.session import work_dir
from lettermill.sinks import commits, files
from lettermill.sinks.merge import MergeTable
from lettermill.sources.topics import read_topic_files, stream_topic_files, write_topic_files
from lettermill.streaming.pipeline import Pipeline, drain, events_table, read_dead_letters

STAMP = "2024-06-01T00:00:00+00:00"
SCHEMA = "event_id string, value long"


@pytest.fixture(scope="module")
def topics(spark, sf_dir):
    path = work_dir(spark, "topics")
    write_topic_files(records(mails(spark, sf_dir)).filter("offset < 120").repartition(3), path)
    return path


def rejections(spark, topics):
    return read_topic_files(spark, topics, rules.TOPIC_REJECTIONS)


def table_of(spark, path=None, buckets=8):
    return MergeTable(spark, path or work_dir(spark, "merged"), spark.createDataFrame([], SCHEMA).schema, "event_id", buckets)


def rows(table):
    return sorted(((r["event_id"], r["value"]) for r in table.read().collect()), key=repr)


def merge(spark, table, pairs, **more):
    return table.merge(spark.createDataFrame(pairs, SCHEMA), [F.col("value")], **more)


def test_merge_replaces_by_id(spark):
    table = table_of(spark)
    assert rows(table) == [] and table.version().number == 0
    merge(spark, table, [(f"e{k}", k) for k in range(50)])
    found = merge(spark, table, [("e3", 300), ("e3", 200), ("new", 1), (None, 7), (None, 7)])
    expected = {f"e{k}": k for k in range(50)} | {"e3": 200, "new": 1}
    assert rows(table) == sorted([*expected.items(), (None, 7), (None, 7)], key=repr)
    assert found.count == len(expected) + 2 and found.number == 2
    merge(spark, table, [(None, 7)])
    assert len(rows(table)) == len(expected) + 3


def test_only_touched_buckets_are_written_anew(spark):
    table = table_of(spark, buckets=16)
    before = merge(spark, table, [(f"e{k}", k) for k in range(200)])
    after = merge(spark, table, [("e5", 1)])
    changed = [b for b in after.folders if after.folders[b] != before.folders[b]]
    assert len(changed) == 1 and after.count == before.count == 200
    # Readers of the version before still see it whole.
    assert table.read(before).filter("event_id = 'e5'").first()["value"] == 5


def test_a_batch_is_put_in_once_and_nothing_is_no_version(spark):
    table = table_of(spark)
    merge(spark, table, [("a", 1)], run_id="r", batch_id=0)
    again = merge(spark, table, [("a", 2)], run_id="r", batch_id=0)
    other = merge(spark, table, [("a", 3)], run_id="s", batch_id=0)
    assert again.number == 1 and other.number == 2 and rows(table) == [("a", 3)]
    assert merge(spark, table, []).number == 2


def test_a_merge_that_loses_the_race_begins_again(spark, monkeypatch):
    table = table_of(spark)
    merge(spark, table, [("a", 1), ("b", 1)])
    put, raced = storage.put_if_absent, []

    def slow(session, path, text):
        if not raced:
            raced.append(path)
            merge(spark, table, [("a", 2), ("c", 2)])
        return put(session, path, text)

    monkeypatch.setattr(storage, "put_if_absent", slow)
    merge(spark, table, [("b", 3), ("c", 3)])
    assert rows(table) == [("a", 2), ("b", 3), ("c", 3)] and table.version().number == 3


def test_a_merge_that_dies_leaves_the_table_as_it_was(spark, monkeypatch):
    table = table_of(spark)
    merge(spark, table, [("a", 1)])

    def dies(*_):
        raise RuntimeError("gone")

    monkeypatch.setattr(storage, "put_if_absent", dies)
    with pytest.raises(RuntimeError):
        merge(spark, table, [("a", 2)])
    assert rows(table) == [("a", 1)]


def test_clean_keeps_what_is_in_use(spark):
    table = table_of(spark)
    for k in range(4):
        merge(spark, table, [("a", k), (f"x{k}", k)])
    expected = rows(table)
    assert table.clean(1) > 0 and rows(table) == expected
    assert len(storage.names(spark, f"{table.path}/versions")) == 1 and table.clean(1) == 0


def test_a_file_is_put_once(spark):
    path = f"{work_dir(spark, 'files')}/one.json"
    assert storage.put_if_absent(spark, path, "é") and not storage.put_if_absent(spark, path, "other")
    assert storage.read_text(spark, path) == "é" and storage.names(spark, path.rsplit("/", 1)[0]) == ["one.json"]
    assert storage.names(spark, f"{path}-none") == [] and storage.remove(spark, path)


def test_an_overlapping_backfill_doubles_nothing(spark, topics):
    events_dir, counts = work_dir(spark, "events"), []
    for _ in range(2):
        pipeline = Pipeline(work_dir(spark, "out"), processed_at=STAMP, events_dir=events_dir, buckets=4)
        streams = {t: stream_topic_files(spark, topics, t) for t in (rules.TOPIC_REJECTIONS, rules.TOPIC_APPLICATIONS)}
        written = drain(spark, pipeline, streams, work_dir(spark, "cp"))
        merged = {kind: events_table(spark, events_dir, kind, 4) for kind in files.FOLDERS}
        counts.append({folder: merged[kind].version().count for kind, folder in files.FOLDERS.items()})
        assert counts[-1] == written
    assert counts[0] == counts[1] and counts[0]["rejections"] > 0
    ids = [r["event_id"] for r in merged["rejection"].read().collect()]
    assert len(ids) == len(set(ids)) and merged["rejection"].read().schema.names == schemas.ENRICHED.names


@pytest.mark.parametrize("sink", ["write_csv", "write_dead_letters"])
def test_a_batch_that_dies_between_sinks_is_invisible(spark, topics, monkeypatch, sink):
    out, pipeline = work_dir(spark, "out"), None

    def dies(*_):
        raise RuntimeError("executor lost")

    pipeline = Pipeline(out, processed_at=STAMP)
    with monkeypatch.context() as patch:
        patch.setattr(files, sink, dies)
        with pytest.raises(RuntimeError):
            pipeline.handle(rejections(spark, topics), 0, "rejection")
    assert files.output_counts(spark, out) == {"rejections": 0, "applications": 0}
    assert files.read_json_lines(spark, out, "rejection").count() == 0 == read_dead_letters(spark, out).count()
    pipeline.handle(rejections(spark, topics), 0, "rejection")
    n = files.output_counts(spark, out)["rejections"]
    assert n == files.read_json_lines(spark, out, "rejection").count() > 0
    assert read_dead_letters(spark, out).count() > 0


def test_counts_read_the_log_alone(spark, topics):
    out = work_dir(spark, "out")
    pipeline = Pipeline(out, processed_at=STAMP)
    for _ in range(2):
        pipeline.handle(rejections(spark, topics), 0, "rejection")
    pipeline.handle(rejections(spark, topics).limit(0), 1, "rejection")
    found = commits.committed_counts(spark, out)
    assert all("/commits/" in path for path in found.inputFiles())
    ((kind, good, bad, batches),) = found.collect()
    read = rejections(spark, topics).count()
    assert (kind, batches) == ("rejection", 1) and good + bad == read
    ((_, _, _, topic, partition, first, last, records_),) = commits.read_ranges(spark, out).collect()
    assert (topic, partition, records_) == (rules.TOPIC_REJECTIONS, 0, read) and first < last


def test_a_failed_second_sink_is_in_the_log(spark, topics):
    def broken(*_):
        raise RuntimeError("sheet is down")

    out = work_dir(spark, "out")
    Pipeline(out, processed_at=STAMP, second_sink=broken).handle(rejections(spark, topics), 0, "rejection")
    assert commits.read_commits(spark, out).first()["second_error"] == "sheet is down"


def plain_gaps(offsets, first=None, last=None):
    have = sorted(set(offsets))
    if first is not None:
        have = [first - 1, *have, last + 1]
    return [(a + 1, b - 1, b - a - 1) for a, b in zip(have, have[1:], strict=False) if b - a > 1]


def test_planted_gaps_are_found_in_slices_of_any_size(spark):
    draw, rows_, expected = random.Random(6), [], []
    for topic, partition in (("a", 0), ("a", 1), ("b", 0)):
        offsets = [k for k in range(300) if draw.random() < 0.8 and not 100 <= k < 180]
        rows_ += [(topic, partition, k) for k in offsets + offsets[:20]]
        expected += [(topic, partition, *g) for g in plain_gaps(offsets)]
    frame = spark.createDataFrame([*rows_, ("a", 0, None)], "topic string, partition int, offset long")
    for size in (1, 16, 1 << 20):
        found = [tuple(r) for r in audit.offset_gaps(frame, slice_offsets=size).collect()]
        assert sorted(found) == sorted(expected), size


def test_ends_and_partitions_that_never_came(spark):
    frame = spark.createDataFrame([("a", 0, 5), ("a", 0, 6)], "topic string, partition int, offset long")
    bounds = spark.createDataFrame([("a", 0, 3, 9), ("a", 1, 0, 4), ("a", 2, 5, 4)], "topic string, partition int, first long, last long")
    found = sorted(tuple(r) for r in audit.offset_gaps(frame, bounds, 4).collect())
    assert found == [("a", 0, 3, 4, 2), ("a", 0, 7, 9, 3), ("a", 1, 0, 4, 5)]
    assert audit.offset_gaps(frame.limit(0)).count() == 0


def test_gaps_between_ranges_that_overlap(spark):
    ranges = [("a", 0, 0, 9, 10), ("a", 0, 5, 7, 3), ("a", 0, 12, 20, 8), ("a", 0, 0, 20, 21), ("a", 0, 30, 31, 2)]
    frame = spark.createDataFrame(ranges, "topic string, partition int, first long, last long, records long")
    assert [tuple(r) for r in audit.range_gaps(frame).collect()] == [("a", 0, 21, 29, 9)]
    assert [r["missing"] for r in audit.short_ranges(frame).collect()] == [1]
