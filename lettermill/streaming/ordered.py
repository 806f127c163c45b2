"""Events of a stream released in the order of their time, source by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "__span"


def order_stream(
    events: DataFrame,
    key: str = "source",
    time: Column | None = None,
    tie: str = "event_id",
    delay: str = "10 minutes",
    span: str = "1 minute",
    name: str = "position",
) -> DataFrame:
    """Events as they come by ``time`` within each ``key``, with their ``name``.

    Events wait in the state of their key and span of time until the watermark,
    ``delay`` behind the newest event, has passed the span; then the span is
    released as a whole, in the order of ``time`` and ``tie``. Spans of a key are
    released one after the other, so what was written before is never later.
    ``name`` is the span's start in microseconds and the place in it, as
    ``<start>-<place>``, both of fixed width: sorted as text it gives the order.

    No task holds more than the spans of ``delay`` of some keys, however busy a
    source is; a busy one needs short spans. Events later than the watermark are
    dropped and counted by the stream's progress (``numRowsDroppedByWatermark``).
    Events without a key are ordered among themselves; those without a time
    never pass the watermark: send them elsewhere first.
    """
    time = F.col("received_at").cast("timestamp") if time is None else time
    timed = events.withColumn("__time", time).withWatermark("__time", delay)
    held = F.struct("__time", F.col(tie).cast("string").alias("__tie"), F.struct(*events.columns).alias("event"))
    spans = timed.groupBy(F.window("__time", span).alias(SPAN), F.col(key).alias("__key")).agg(
        F.sort_array(F.collect_list(held)).alias("held")
    )
    placed = spans.select(SPAN, F.posexplode("held").alias("__at", "h"))
    start = F.lpad(F.unix_micros(F.col(f"{SPAN}.start")).cast("string"), 18, "0")
    position = F.concat(start, F.lit("-"), F.lpad(F.col("__at").cast("string"), 9, "0"))
    return placed.select("h.event.*", position.alias(name))
