"""Metrics of a batch as appended table rows."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.operators.metrics import batch_metrics, label_distribution, metric_rows
from lettermill.sinks.files import FIRST_RUN

log = logging.getLogger(__name__)


def write_batch_metrics(
    enriched: DataFrame,
    out_dir: str,
    backend: str,
    event_type: str,
    batch_id: int,
    latency_seconds: float,
    run_id: str = FIRST_RUN,
) -> bool:
    """Write one batch's metrics; a failure is logged and never ends the pipeline."""
    try:
        keyed = enriched.select(
            F.lit(batch_id).cast("long").alias("batch_id"),
            F.lit(backend).alias("backend"),
            F.lit(event_type).alias("event_type"),
            "company_name",
            "role_title",
            "rejection_type",
            "confidence",
        )
        rows = metric_rows(
            batch_metrics(keyed, latency_seconds=F.lit(latency_seconds)),
            label_distribution(keyed),
        )
        # A handful of rows: one file.
        rows.drop("batch_id", "event_type").coalesce(1).write.mode("overwrite").parquet(
            f"{out_dir}/metrics/event_type={event_type}/run_id={run_id}/batch_id={batch_id}"
        )
        return True
    except Exception as exc:
        log.warning("metrics of batch %s not written: %s", batch_id, exc)
        return False
