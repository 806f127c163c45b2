"""Topics as streams or tables: from Kafka, or from files with the same columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill import schemas


def kafka_read_options(
    servers: str, topic: str, earliest: bool = False, **more: str
) -> dict[str, str]:
    """Options of the Kafka source: new records only, or everything for a backfill."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest" if earliest else "latest",
        "failOnDataLoss": "false",
        **more,
    }


def kafka_write_options(servers: str, **more: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.acks": "all",
        "kafka.retries": "5",
        "kafka.retry.backoff.ms": "300",
        "kafka.compression.type": "lz4",
        "kafka.linger.ms": "20",
        **more,
    }


def read_kafka_topic(
    spark: SparkSession, servers: str, topic: str, earliest: bool = False, **more: str
) -> DataFrame:
    options = kafka_read_options(servers, topic, earliest, **more)
    return spark.readStream.format("kafka").options(**options).load()


def write_kafka(records: DataFrame, servers: str, **more: str) -> None:
    """Publish records (``topic, key, value, headers``) in one batch."""
    records.write.format("kafka").options(**kafka_write_options(servers, **more)).save()


def write_topic_files(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records as files, one folder per topic: the file form of a publish."""
    columns = [c for c in schemas.ENVELOPE.names if c in records.columns]
    (
        records.select(*columns)
        .withColumn("timestamp", F.current_timestamp())
        .write.mode(mode)
        .option("compression", "lz4")
        .partitionBy("topic")
        .parquet(path)
    )


def stream_topic_files(
    spark: SparkSession, path: str, topic: str, max_files_per_batch: int | None = None
) -> DataFrame:
    """One topic's files as a stream with Kafka's columns.

    A fresh checkpoint reads from the earliest file. Files that vanish between
    listing and reading are skipped, as lost offsets are.
    """
    reader = (
        spark.readStream.schema(_file_schema()).option("ignoreMissingFiles", "true")
    )
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.parquet(f"{path}/topic={topic}").withColumn("topic", F.lit(topic))


def read_topic_files(
    spark: SparkSession, path: str, topic: str | None = None, since: dt.date | None = None
) -> DataFrame:
    """Topic files as a table; the topic prunes folders and ``since`` rows."""
    records = (
        spark.read.schema(schemas.ENVELOPE).option("ignoreMissingFiles", "true").parquet(path)
    )
    if topic is not None:
        records = records.filter(F.col("topic") == topic)
    if since is not None:
        records = records.filter(F.col("timestamp") >= F.lit(since.isoformat()))
    return records


def _file_schema():
    fields = [f for f in schemas.ENVELOPE.fields if f.name != "topic"]
    return type(schemas.ENVELOPE)(fields)
