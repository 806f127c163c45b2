"""Jobs to submit: the consumer of both topics, the ingest of a mail table, training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill import rules
from lettermill.models.backends import backend_name, labeller_for
from lettermill.models.fitted import save_model, train
from lettermill.sinks.files import sheet_sink
from lettermill.sources.files import read_labelled
from lettermill.sources.mailboxes import stream_message_files
from lettermill.sources.topics import read_kafka_topic, write_kafka
from lettermill.streaming.ingest import Ingest, Publish
from lettermill.streaming.pipeline import EVENT_TYPE_OF_TOPIC, Pipeline, SecondSink, run


def consume(
    spark: SparkSession,
    servers: str,
    out_dir: str = "output",
    checkpoint_dir: str = "checkpoints",
    backend: str | None = None,
    model_path: str | None = None,
    second_sink: SecondSink | None = None,
    sheet_dir: str | None = None,
    earliest: bool = False,
    every: str = "30 seconds",
) -> dict[str, int]:
    """Read both topics from Kafka until stopped; returns the rows written per kind.

    ``sheet_dir`` keeps the sheets as tables there, unless ``second_sink`` says
    otherwise. Needs the Kafka connector of the running Spark version on the class path.
    """
    name = backend_name(backend)
    if second_sink is None and sheet_dir is not None:
        second_sink = sheet_sink(sheet_dir)
    pipeline = Pipeline(
        out_dir, backend=name, labeller=labeller_for(name, model_path), second_sink=second_sink
    )
    queries = [
        pipeline.start(
            read_kafka_topic(spark, servers, topic, earliest),
            event_type,
            f"{checkpoint_dir}/{event_type}",
            every,
        )
        for topic, event_type in EVENT_TYPE_OF_TOPIC.items()
    ]
    return run(spark, queries, out_dir)


def ingest(
    mails: DataFrame,
    servers: str,
    processed_path: str,
    checkpoint: str,
    every: str | None = "60 seconds",
):
    """Publish a stream of flat mail to Kafka."""
    job = Ingest(lambda records, _: write_kafka(records, servers), processed_path)
    return job.poll(mails, checkpoint, every)


def poll_message_files(
    spark: SparkSession,
    path: str,
    publish: Publish,
    processed_path: str,
    checkpoint: str,
    every: str | None = "60 seconds",
    max_bytes: int | None = rules.MAX_MESSAGE_BYTES,
):
    """Publish the mail of message files as they appear in a folder."""
    job = Ingest(publish, processed_path, max_bytes=max_bytes)
    return job.poll(stream_message_files(spark, path), checkpoint, every)


def train_from_files(
    spark: SparkSession,
    data_path: str,
    output_path: str,
    epochs: int = 3,
    words: int | None = None,
) -> list[float]:
    """Fit on JSON lines of ``text, label`` and save; returns each epoch's held-out loss."""
    model, losses = train(read_labelled(spark, data_path), epochs=epochs, words=words)
    save_model(model, output_path)
    return losses
