"""The ingest job: new mail is classified, made into events and published once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill import rules
from lettermill.functions.text import or_empty
from lettermill.operators.classify import classify
from lettermill.operators.deadletter import dead_letter_json, refused, to_dead_letters
from lettermill.operators.events import make_events, route, to_envelopes
from lettermill.operators.select import first_delivery, unseen
from lettermill.sources.mailboxes import mark_processed, read_processed_ids
from lettermill.streaming.runs import stream_run

Publish = Callable[[DataFrame, int], None]


@dataclass
class Ingest:
    """Publish unseen mail and remember its ids.

    ``publish`` gets topic records and the batch id. Ids are remembered only
    after it returns, so mail is never lost; a batch that fails in between is
    published again under the same event ids. Ids are kept by run and batch, as
    batch ids start again with a new checkpoint; without a stream the run is
    ``run_id``. A record the broker would refuse, longer than ``max_bytes`` or
    without a key, becomes a dead letter instead of failing its batch.
    """

    publish: Publish
    processed_path: str
    producer_name: str = "ingest"
    max_bytes: int | None = rules.MAX_MESSAGE_BYTES
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def handle(self, mails: DataFrame, batch_id: int) -> None:
        """One batch of flat mail: ``uid, source, subject, sender, received_at, body``.

        Mail with an ``error`` becomes a dead letter and does not stop the rest.
        """
        run_id = stream_run(mails) or self.run_id
        processed = read_processed_ids(mails.sparkSession, self.processed_path)
        keyed = mails.withColumn("uid", F.col("uid").cast("string"))
        if "error" not in keyed.columns:
            keyed = keyed.withColumn("error", F.lit(None).cast("string"))
        # Decoding a message is costly, so the batch is kept before anything reads it.
        keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
        dated = F.nullif(or_empty(F.col("received_at")), F.lit(""))
        oldest = keyed.agg(F.min(dated)).scalar()
        # A batch that runs again must not find its own ids. One mail has one
        # date, so ids older than all dated mail of the batch are not read; ids
        # without a date always are.
        others = processed.filter(
            ((F.col("run_id") != run_id) | (F.col("batch_id") != batch_id))
            & ((F.col("received_at") == "") | (F.col("received_at") >= oldest))
        )
        order = ("received_at", "subject", "sender", "body")
        new = first_delivery(unseen(keyed, others), "uid", order)
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            readable = new.filter(F.col("error").isNull())
            records = refused(to_envelopes(make_events(route(classify(readable)))), self.max_bytes)
            self.publish(
                records.filter(F.col("refusal").isNull()).drop("refusal"), batch_id
            )
            turned_away = to_dead_letters(
                records.filter(F.col("refusal").isNotNull()),
                F.col("topic"),
                F.col("refusal"),
                F.col("value").cast("string"),
                self.producer_name,
            )
            broken = to_dead_letters(
                new.filter(F.col("error").isNotNull()),
                F.lit(rules.TOPIC_REJECTIONS),
                F.col("error"),
                F.col("uid"),
                self.producer_name,
            )
            self.publish(dead_letter_json(broken.unionByName(turned_away)), batch_id)
            mark_processed(new, self.processed_path, batch_id, run_id)
        finally:
            new.unpersist()
            keyed.unpersist()

    def poll(
        self, mails: DataFrame, checkpoint: str, every: str | None = "60 seconds"
    ) -> StreamingQuery:
        """Poll a mail stream; ``every=None`` takes what is there and ends."""
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return (
            mails.writeStream.foreachBatch(self.handle)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
