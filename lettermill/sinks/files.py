"""Outputs of one batch.

Each attempt at a batch of a run writes to folders of its own, which readers see
once the attempt is in the log of commits: a batch that runs again takes the
place of what it wrote, so every event appears once in the output. Batch ids
start at 0 with every new checkpoint, so the run is part of the key and a new
run adds to what earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill import schemas
from lettermill.operators.display import application_rows, rejection_rows
from lettermill.sinks.commits import commit, committed, committed_counts, new_attempt, read_commits

FIRST_RUN = "single"
FIRST_ATTEMPT = "first"
FOLDERS = {"rejection": "rejections", "application": "applications"}


def batch_path(
    out_dir: str, name: str, form: str, batch_id: int, run_id: str, attempt: str | None = None
) -> str:
    path = f"{out_dir}/{name}/{form}/run_id={run_id}/batch_id={batch_id}"
    return path if attempt is None else f"{path}/attempt={attempt}"


def json_records(enriched: DataFrame, event_type: str, processed_at: Column) -> DataFrame:
    """The payload with what enrichment found, one column per fact.

    An application keeps the ``rejection_type`` its payload came with, if any.
    """
    label = "rejection_type" if event_type == "rejection" else "payload_rejection_type"
    fields = [
        F.col(label).alias(name) if name == "rejection_type" else F.col(name)
        for name in schemas.ENRICHED_FIELDS
    ]
    return enriched.select(
        *fields, F.col("confidence").alias("nlp_confidence"), processed_at.alias("processed_at")
    )


def write_json_lines(
    records: DataFrame, out_dir: str, event_type: str, batch_id: int, run_id: str = FIRST_RUN,
    attempt: str | None = None,
) -> None:
    """Null fields are kept, as every line has all keys.

    Without an ``attempt`` the lines are all of the batch: it is committed here.
    """
    spark, own = records.sparkSession, attempt or new_attempt()
    path = batch_path(out_dir, FOLDERS[event_type], "jsonl", batch_id, run_id, own)
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    if attempt is None:
        commit(spark, out_dir, event_type, run_id, batch_id, own, spark.read.text(path).count(), 0)


def write_csv(
    rows: DataFrame, out_dir: str, event_type: str, batch_id: int, run_id: str = FIRST_RUN,
    attempt: str = FIRST_ATTEMPT,
) -> None:
    """A header per part file, quotes doubled, empty text left empty."""
    (
        rows.write.mode("overwrite")
        .option("header", "true")
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(batch_path(out_dir, FOLDERS[event_type], "csv", batch_id, run_id, attempt))
    )


def summary_rows(enriched: DataFrame, event_type: str) -> DataFrame:
    return rejection_rows(enriched) if event_type == "rejection" else application_rows(enriched)


def sheet_rows(enriched: DataFrame, event_type: str) -> DataFrame:
    """The summary under sheet titles."""
    if event_type == "rejection":
        return rejection_rows(enriched, schemas.REJECTION_TITLES)
    return application_rows(enriched, schemas.APPLICATION_TITLES)


def write_sheet_table(
    enriched: DataFrame, out_dir: str, event_type: str, batch_id: int, run_id: str = FIRST_RUN
) -> None:
    """The sheet as a parquet table; titles contain spaces, so they are kept as they are."""
    (
        sheet_rows(enriched, event_type)
        .write.mode("overwrite")
        .parquet(batch_path(out_dir, FOLDERS[event_type], "sheet", batch_id, run_id))
    )


def sheet_sink(out_dir: str) -> Callable[[DataFrame, str, int, str], None]:
    """A second sink that keeps the sheets as tables below ``out_dir``."""
    return lambda good, event_type, batch_id, run_id: write_sheet_table(
        good, out_dir, event_type, batch_id, run_id
    )


def write_dead_letters(
    letters: DataFrame, out_dir: str, event_type: str, batch_id: int, run_id: str = FIRST_RUN,
    attempt: str = FIRST_ATTEMPT,
) -> None:
    folder = f"{out_dir}/dead_letters/event_type={event_type}/run_id={run_id}/batch_id={batch_id}"
    letters.write.mode("overwrite").json(f"{folder}/attempt={attempt}")


def _read_or_none(spark: SparkSession, schema, path: str, **options: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return None


def read_json_lines(spark: SparkSession, out_dir: str, event_type: str) -> DataFrame:
    """All committed batches' JSON lines with their ``run_id`` and ``batch_id``."""
    written = _read_or_none(spark, _with_folders(schemas.ENRICHED), f"{out_dir}/{FOLDERS[event_type]}/jsonl")
    if written is None:
        return spark.createDataFrame([], _with_folders(schemas.ENRICHED)).drop("attempt")
    return committed(written, read_commits(spark, out_dir), event_type).drop("attempt")


def read_dead_letters(spark: SparkSession, out_dir: str) -> DataFrame:
    """All committed dead letters with their event kind, run and batch."""
    schema = _with_folders(schemas.DEAD_LETTER, "event_type")
    written = _read_or_none(spark, schema, f"{out_dir}/dead_letters")
    if written is None:
        return spark.createDataFrame([], schema).drop("attempt")
    return committed(written, read_commits(spark, out_dir)).drop("attempt")


def _with_folders(schema: StructType, *before: str) -> StructType:
    """A schema with the folder columns of a batch's output."""
    out = StructType([f for f in schema.fields if f.name not in before])
    for name in before:
        out = out.add(name, "string")
    return out.add("run_id", "string").add("batch_id", "long").add("attempt", "string")


def output_counts(spark: SparkSession, out_dir: str) -> dict[str, int]:
    """Events written so far per kind, from the log of commits: no output is read."""
    rows = {r["event_type"]: r["rows"] for r in committed_counts(spark, out_dir).collect()}
    return {folder: rows.get(kind, 0) for kind, folder in FOLDERS.items()}
