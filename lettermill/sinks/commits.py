"""The log of committed batches: what readers of the output may see.

A batch writes its outputs under an attempt of its own and, last of all, one row
to the log. Readers take from the outputs only attempts that the log names, so a
batch that died between two sinks is invisible, and one that runs again
replaces its earlier attempt in one step. Counts come from the log alone.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill import storage

COMMIT = (
    "event_type string, run_id string, batch_id long, attempt string, committed_at long, "
    "rows long, dead_letters long, seconds double, second_error string, "
    "ranges array<struct<topic:string,partition:int,first:long,last:long,records:long>>"
)
RANGE = ["topic", "partition", "first", "last", "records"]
KEYS = ["event_type", "run_id", "batch_id"]


def new_attempt() -> str:
    return uuid.uuid4().hex


def log_path(out_dir: str) -> str:
    return f"{out_dir}/commits"


def commit(
    spark: SparkSession,
    out_dir: str,
    event_type: str,
    run_id: str,
    batch_id: int,
    attempt: str,
    rows: int,
    dead_letters: int,
    seconds: float | None = None,
    second_error: str | None = None,
    ranges: list[tuple] | None = None,
) -> None:
    """Make an attempt of a batch visible. Call it when all its outputs are written.

    ``ranges`` are those of the offsets it read: a row for each partition of the topic.
    """
    places = None if ranges is None else [dict(zip(RANGE, r, strict=True)) for r in ranges]
    row = {
        "event_type": event_type, "run_id": run_id, "batch_id": batch_id, "attempt": attempt, "committed_at": time.time_ns(),
        "rows": rows, "dead_letters": dead_letters, "seconds": seconds, "second_error": second_error, "ranges": places,
    }
    # One small file, put in its place whole: streams commit at the same time.
    storage.put_if_absent(spark, f"{log_path(out_dir)}/{event_type}-{run_id}-{batch_id}-{attempt}.json", json.dumps(row))


def read_commits(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per committed batch: its last attempt. Without a log, no rows."""
    try:
        log = spark.read.schema(COMMIT).json(log_path(out_dir))
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        log = spark.createDataFrame([], COMMIT)
    rest = [c for c in log.columns if c not in KEYS]
    last = F.max_by(F.struct(*rest), F.struct("committed_at", "attempt")).alias("last")
    return log.groupBy(*KEYS).agg(last).select(*KEYS, "last.*")


def committed(outputs: DataFrame, commits: DataFrame, event_type: str | None = None) -> DataFrame:
    """Rows of ``outputs`` that committed attempts wrote.

    ``outputs`` has the folders ``run_id``, ``batch_id`` and ``attempt`` as columns, and
    ``event_type`` where that is not given. The log has a row a batch, so it is
    small beside them; joined on the folders, it also keeps uncommitted folders
    from being read.
    """
    keys = ["run_id", "batch_id", "attempt"]
    if event_type is None:
        keys = ["event_type", *keys]
    else:
        commits = commits.filter(F.col("event_type") == event_type)
    named = commits.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [outputs[k].cast("string") == named[f"__{k}"].cast("string") for k in keys]
    return outputs.join(named, same, "left_semi")


def committed_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """``event_type``, ``rows``, ``dead_letters`` and ``batches``, from the log alone."""
    return read_commits(spark, out_dir).groupBy("event_type").agg(
        F.sum("rows").alias("rows"), F.sum("dead_letters").alias("dead_letters"), F.count(F.lit(1)).alias("batches")
    )


def read_ranges(spark: SparkSession, out_dir: str) -> DataFrame:
    """``topic, partition, first, last, records`` of the offsets each committed batch read."""
    ranges = read_commits(spark, out_dir).select("event_type", "run_id", "batch_id", F.explode("ranges").alias("r"))
    return ranges.select("event_type", "run_id", "batch_id", "r.*")
