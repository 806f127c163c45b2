"""Which run a batch belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stream_run(batch: DataFrame) -> str | None:
    """The id of the streaming query that hands over this batch, or None outside a stream.

    Spark keeps the id in the checkpoint: a restart has it again, a new
    checkpoint, whose batches count from 0 again, has another.
    """
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
