"""Quality metrics of enriched batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.functions.text import or_empty

KEYS = ("batch_id", "backend", "event_type")
MIN_LATENCY_SECONDS = 0.001


def _share(found: Column) -> Column:
    return F.avg(F.when(found, F.lit(1.0)).otherwise(F.lit(0.0)))


def _score() -> Column:
    return F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))


def throughput(rows: Column, seconds: Column) -> Column:
    return rows / F.greatest(seconds.cast("double"), F.lit(MIN_LATENCY_SECONDS))


def batch_metrics(
    enriched: DataFrame, keys: Sequence[str] = KEYS, latency_seconds: Column | None = None
) -> DataFrame:
    """One row per batch; a batch without rows yields none.

    Every aggregate has a partial form, so a task sends one row per batch.
    """
    metrics = enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.avg(_score()).alias("avg_confidence"),
        F.min(_score()).alias("min_confidence"),
        F.max(_score()).alias("max_confidence"),
        _share(or_empty(F.col("company_name")) != "").alias("company_extraction_rate"),
        _share(or_empty(F.col("role_title")) != "").alias("role_extraction_rate"),
    )
    if latency_seconds is None:
        return metrics
    return metrics.withColumn(
        "batch_latency_seconds", latency_seconds.cast("double")
    ).withColumn(
        "throughput_events_per_sec",
        throughput(F.col("batch_size"), F.col("batch_latency_seconds")),
    )


def label_distribution(
    enriched: DataFrame, keys: Sequence[str] = KEYS, label: str = "rejection_type"
) -> DataFrame:
    """Count and share of each label within its batch.

    The total is summed over the few counted rows, not over the events.
    """
    name = F.replace(F.coalesce(F.col(label), F.lit("n/a")), F.lit(" "), F.lit("_"))
    counts = enriched.groupBy(*keys, name.alias("label")).agg(
        F.count(F.lit(1)).alias("label_count")
    )
    total = F.sum("label_count").over(W.partitionBy(*keys))
    return counts.withColumn("label_pct", F.col("label_count") / total)


def metric_rows(
    metrics: DataFrame, distribution: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Metrics as ``key, value`` rows: one per figure and two per label."""
    figures = [c for c in metrics.columns if c not in keys]
    wide = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in figures])
    long = wide.unpivot(list(keys), figures, "key", "value")
    labels = distribution.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("label_count_"), "label").alias("key"),
                    F.col("label_count").cast("double").alias("value"),
                ),
                F.struct(
                    F.concat(F.lit("label_pct_"), "label").alias("key"),
                    F.col("label_pct").alias("value"),
                ),
            )
        ).alias("m"),
    ).select(*keys, "m.key", "m.value")
    return long.unionByName(labels)


def backend_comparison(scored: DataFrame) -> DataFrame:
    """Average confidence and sample size per backend; absent backends give no row."""
    return scored.groupBy("backend").agg(
        F.avg(_score()).alias("avg_confidence"), F.count(F.lit(1)).alias("sample_size")
    )


def output_summary(events: DataFrame, kinds: Sequence[str] = ("rejection", "application")) -> DataFrame:
    """Rows per kind, zero included, from one pass."""
    counts = events.agg(*[F.count_if(F.col("event_type") == kind).alias(kind) for kind in kinds])
    return counts.unpivot([], list(kinds), "event_type", "rows")
