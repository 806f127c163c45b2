"""Mail tables: messages of a mail REST service, message files, consumed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill import schemas
from lettermill.functions.html import html_text
from lettermill.functions.mime import body_text, decode_message
from lettermill.functions.text import or_empty


def read_graph_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GRAPH_MESSAGE).json(path)


def normalise_messages(messages: DataFrame, source: str = "outlook", to_text=html_text) -> DataFrame:
    """Nested messages as flat mail; missing parts become empty, HTML becomes text."""
    content = or_empty(F.col("body.content"))
    is_html = F.lower(or_empty(F.col("body.contentType"))) == "html"
    return messages.select(
        F.col("id").alias("uid"),
        F.lit(source).alias("source"),
        or_empty(F.col("subject")).alias("subject"),
        or_empty(F.col("from.emailAddress.address")).alias("sender"),
        or_empty(F.col("receivedDateTime")).alias("received_at"),
        F.when(is_html, to_text(content)).otherwise(content).alias("body"),
    )


def read_message_files(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """RFC 822 files below a folder, decoded."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return decode_messages(files.select("path", "content"), F.col("path"))


def stream_message_files(
    spark: SparkSession, path: str, pattern: str = "*.eml", max_files: int | None = None
) -> DataFrame:
    """New RFC 822 files below a folder as a stream of flat mail."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return decode_messages(reader.load(path).select("path", "content"), F.col("path"))


def stream_graph_messages(spark: SparkSession, path: str) -> DataFrame:
    """New files of REST messages, one JSON object a line, as a stream of flat mail."""
    return normalise_messages(spark.readStream.schema(schemas.GRAPH_MESSAGE).json(path))


def decode_messages(raw: DataFrame, uid: Column, source: str = "gmail") -> DataFrame:
    """Raw messages (``content`` binary) as flat mail, with ``error`` where unreadable."""
    decoded = raw.select(
        uid.alias("uid"), F.lit(source).alias("source"), decode_message("content").alias("m")
    )
    return decoded.select(
        "uid",
        "source",
        F.col("m.subject").alias("subject"),
        F.col("m.sender").alias("sender"),
        F.col("m.received_at").alias("received_at"),
        body_text(F.col("m.parts")).alias("body"),
        F.col("m.error").alias("error"),
    )


def read_processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids consumed so far; none before the first batch was marked."""
    schema = "uid string, received_at string, run_id string, batch_id long"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # only a folder that is not there yet counts as empty
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def mark_processed(mails: DataFrame, path: str, batch_id: int, run_id: str = "single") -> None:
    """Record consumed ids; call it after the batch's events are written.

    A batch that runs again replaces its own ids and no other run's. Mail without
    an id leaves none. The date is kept so that a
    later batch can skip ids older than all its mail.
    """
    (
        mails.select(
            F.col("uid").cast("string").alias("uid"),
            or_empty(F.col("received_at")).alias("received_at"),
        )
        .filter("uid IS NOT NULL")
        .write.mode("overwrite")
        .parquet(f"{path}/run_id={run_id}/batch_id={batch_id}")
    )
