"""The streaming job: each topic's records are parsed, enriched and written per batch."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill import rules, schemas
from lettermill.operators.deadletter import dead_letters, parse_payloads
from lettermill.operators.enrich import enrich
from lettermill.operators.events import utc_now
from lettermill.sinks import commits, files
from lettermill.sinks.merge import BUCKETS, MergeTable
from lettermill.sinks.metrics import write_batch_metrics
from lettermill.streaming.runs import stream_run

log = logging.getLogger(__name__)

EVENT_TYPE_OF_TOPIC = {
    rules.TOPIC_REJECTIONS: "rejection",
    rules.TOPIC_APPLICATIONS: "application",
}
SecondSink = Callable[[DataFrame, str, int, str], None]


@dataclass
class Pipeline:
    """What the batch handler needs to know.

    ``second_sink`` gets the enriched batch, its kind, its id and its run's id; when
    it fails the failure is logged and the batch goes on. A batch's output is keyed
    by the stream's checkpoint and the batch id; batches handed over without a stream
    belong to ``run_id``, by default a new one for every pipeline. Give a backfill a
    name of its own to replace its output when it runs again. Outputs are seen once
    the batch is committed, after all of them. With ``events_dir`` a batch's events
    are also merged by id into a table there, one for each kind: a backfill that
    overlaps what is there replaces events and doubles none. With ``stage_dir`` the enriched
    batch is written to a table there and every output reads that; without it
    the batch is cached, which suits batches that fit the executors' disks.
    """

    out_dir: str
    backend: str = "rules"
    labeller: Callable[[DataFrame, str, str], DataFrame] | None = None
    producer_name: str = "stream"
    second_sink: SecondSink | None = None
    processed_at: str | None = None
    max_bytes: int | None = None
    stage_dir: str | None = None
    events_dir: str | None = None
    buckets: int = BUCKETS
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    failures: list[str] = field(default_factory=list)

    def enrich_batch(self, records: DataFrame, event_type: str) -> DataFrame:
        """Records with payload, failure reason and enriched fields, bad ones included."""
        parsed = parse_payloads(records, max_bytes=self.max_bytes)
        flat = parsed.select(
            *[c for c in ("topic", "partition", "offset") if c in parsed.columns],
            F.when(F.col("failure_reason").isNotNull(), F.col("payload")).alias("payload"),
            "failure_reason",
            "event.*",
            F.col("event.rejection_type").alias("payload_rejection_type"),
        )
        return enrich(flat, event_type, labeller=self.labeller)

    def handle(self, records: DataFrame, batch_id: int, event_type: str) -> None:
        """Write one batch, of a stream or of a backfill from a topic's table.

        All outputs come from one kept result: the records are parsed and
        enriched once, and the source is read once.
        """
        started = time.perf_counter()
        run_id = stream_run(records) or self.run_id
        batch = self._keep(self.enrich_batch(records, event_type), event_type, batch_id, run_id)
        try:
            if not batch.isEmpty():
                self._write(batch, event_type, batch_id, run_id, started)
        finally:
            batch.unpersist()

    def _keep(self, batch: DataFrame, event_type: str, batch_id: int, run_id: str) -> DataFrame:
        if self.stage_dir is None:
            return batch.persist(StorageLevel.MEMORY_AND_DISK)
        path = f"{self.stage_dir}/event_type={event_type}/run_id={run_id}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        return batch.sparkSession.read.schema(batch.schema).parquet(path)

    def _write(
        self, batch: DataFrame, event_type: str, batch_id: int, run_id: str, started: float
    ) -> None:
        stamp = utc_now() if self.processed_at is None else F.lit(self.processed_at)
        attempt = commits.new_attempt()
        where = (self.out_dir, event_type, batch_id, run_id, attempt)
        good = batch.filter(F.col("failure_reason").isNull())
        lines = files.json_records(good, event_type, stamp)
        files.write_json_lines(lines, *where)
        files.write_csv(files.summary_rows(good, event_type), *where)
        letters = dead_letters(batch, self.producer_name, stamp)
        files.write_dead_letters(letters.drop("topic"), *where)
        if self.events_dir is not None:
            self._merge(good, event_type, batch_id, run_id, stamp)
        second_error = self._write_second(good, event_type, batch_id, run_id)
        seconds = time.perf_counter() - started
        write_batch_metrics(good, self.out_dir, self.backend, event_type, batch_id, seconds, run_id)
        sizes = batch.agg(
            F.count_if(F.col("failure_reason").isNull()).alias("good"),
            F.count_if(F.col("failure_reason").isNotNull()).alias("bad"),
        ).first()
        commits.commit(
            batch.sparkSession, self.out_dir, event_type, run_id, batch_id, attempt,
            sizes["good"], sizes["bad"], seconds, second_error, self._ranges(batch),
        )

    def _ranges(self, batch: DataFrame) -> list[tuple] | None:
        """Offsets read from each partition of the topic, for the audit of gaps."""
        if not {"topic", "partition", "offset"} <= set(batch.columns):
            return None
        found = batch.filter("offset IS NOT NULL").groupBy("topic", F.col("partition").cast("int").alias("partition"))
        ranges = found.agg(F.min("offset"), F.max("offset"), F.count(F.lit(1)))
        return [tuple(r) for r in ranges.collect()]

    def _merge(self, good: DataFrame, event_type: str, batch_id: int, run_id: str, stamp: Column) -> None:
        table = events_table(good.sparkSession, self.events_dir, event_type, self.buckets)
        rows = files.json_records(good, event_type, stamp)
        position = [F.col(c) for c in ("partition", "offset") if c in good.columns]
        if position:
            # A record without an id is told apart by its place in the topic, so a replay replaces it too.
            place = F.concat_ws(":", F.lit("at"), *[c for c in ("topic", "partition", "offset") if c in good.columns])
            rows = files.json_records(
                good.withColumn("event_id", F.coalesce("event_id", place)), event_type, stamp
            )
        # Of copies in one batch any will do if they are alike: the order makes the choice the same each time.
        order = [F.xxhash64(*rows.columns)]
        table.merge(rows, order, run_id, batch_id)

    def _write_second(self, good: DataFrame, event_type: str, batch_id: int, run_id: str) -> str | None:
        """What went wrong, if anything did."""
        if self.second_sink is None:
            return None
        try:
            self.second_sink(good, event_type, batch_id, run_id)
            return None
        except Exception as exc:
            self.failures.append(f"{event_type} batch {batch_id}: {exc}")
            log.error("second sink failed for %s batch %s: %s", event_type, batch_id, exc)
            return str(exc)[:500]

    def start(
        self,
        records: DataFrame,
        event_type: str,
        checkpoint: str,
        every: str | None = "30 seconds",
    ) -> StreamingQuery:
        """Start the query of one topic; ``every=None`` drains what is there and ends."""
        writer = (
            records.writeStream.foreachBatch(
                lambda df, batch_id: self.handle(df, batch_id, event_type)
            ).option("checkpointLocation", checkpoint)
        )
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return writer.trigger(**trigger).start()


def run(spark: SparkSession, queries: list[StreamingQuery], out_dir: str) -> dict[str, int]:
    """Wait until any query ends, stop the rest and report what was written."""
    try:
        if all(query.isActive for query in queries):
            # Queries that ended before these were started do not count.
            spark.streams.resetTerminated()
            spark.streams.awaitAnyTermination()
    finally:
        for query in queries:
            query.stop()
    return files.output_counts(spark, out_dir)


def drain(
    spark: SparkSession, pipeline: Pipeline, streams: dict[str, DataFrame], checkpoint_dir: str
) -> dict[str, int]:
    """Process everything present in the topics, all queries at once, then stop."""
    queries = [
        pipeline.start(records, EVENT_TYPE_OF_TOPIC[topic], f"{checkpoint_dir}/{topic}", None)
        for topic, records in streams.items()
    ]
    for query in queries:
        query.awaitTermination()
    return files.output_counts(spark, pipeline.out_dir)


def batch_seconds(query: StreamingQuery) -> float | None:
    """Wall-clock seconds of the last batch, as the query reports them."""
    progress = query.lastProgress
    return None if progress is None else progress["durationMs"]["triggerExecution"] / 1000


def read_dead_letters(spark: SparkSession, out_dir: str) -> DataFrame:
    """All dead letters with their event kind and batch."""
    return files.read_dead_letters(spark, out_dir)


def events_table(spark: SparkSession, events_dir: str, event_type: str, buckets: int = BUCKETS) -> MergeTable:
    """The table of one kind's events that ``Pipeline(events_dir=...)`` merges into."""
    return MergeTable(spark, f"{events_dir}/{files.FOLDERS[event_type]}", schemas.ENRICHED, "event_id", buckets)


def dedup_stream(
    events: DataFrame,
    delay: str = "1 hour",
    key: str = "event_id",
    spread: Column | None = None,
    salts: int = 32,
) -> DataFrame:
    """Drop repeats of an event that arrive within the delay of each other.

    The clock is that of arrival, not the sender's: a mail dated in the future
    makes no other late, and nothing that arrives is ever dropped for its age. Ids are
    held as state for the delay. Events without an id all pass.

    A stream has no partial step before its shuffle, so all copies of one event
    meet in one task. With ``spread``, a column that differs between copies,
    such as the offset, copies are first dropped in ``salts`` separate slices,
    and at most that many of each event go on to the final step.
    """
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("no id "), F.expr("uuid()")))
    timed = (
        events.withColumn("arrived_at", F.current_timestamp())
        .withWatermark("arrived_at", delay)
        .withColumn("__key", own)
    )
    if spread is not None:
        sliced = timed.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        timed = sliced.dropDuplicatesWithinWatermark(["__key", "__salt"]).drop("__salt")
    return timed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")
