"""Lost records: offsets of a topic that nobody read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE = 1 << 20
PLACE = ["topic", "partition"]


def offset_gaps(records: DataFrame, bounds: DataFrame | None = None, slice_offsets: int = SLICE) -> DataFrame:
    """Runs of offsets that are missing: ``topic, partition, first_missing, last_missing, missing``.

    ``records`` has ``topic, partition, offset``; repeats are no gaps and rows without
    an offset are left out. ``bounds`` (``topic, partition, first, last``) adds what
    should be there at either end, and partitions of which nothing arrived.

    A partition may hold a third of all records, so it is cut into ranges of
    ``slice_offsets`` offsets. A range's rows are compared with the row before
    them; what lies between two ranges is found from their edges, one row each.
    """
    rows = records.select("topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"))
    rows = rows.filter("offset IS NOT NULL")
    if bounds is not None:
        ends = F.explode(F.array(F.col("first").cast("long") - 1, F.col("last").cast("long") + 1))
        rows = rows.unionByName(bounds.select("topic", F.col("partition").cast("int").alias("partition"), ends.alias("offset")))
    # Repeats go before the rows are ordered, first within each task.
    sliced = rows.withColumn("slice", F.floor(F.col("offset") / slice_offsets).cast("long")).distinct()
    within = W.partitionBy(*PLACE, "slice").orderBy("offset")
    inside = sliced.select(*PLACE, F.lag("offset").over(within).alias("before"), F.col("offset").alias("after"))
    edges = sliced.groupBy(*PLACE, "slice").agg(F.min("offset").alias("after"), F.max("offset").alias("last"))
    between = edges.select(*PLACE, F.lag("last").over(W.partitionBy(*PLACE).orderBy("slice")).alias("before"), "after")
    return _runs(inside.unionByName(between))


def range_gaps(ranges: DataFrame) -> DataFrame:
    """The same from ranges of offsets that batches read: ``topic, partition, first, last``.

    One row a batch and partition. Ranges may overlap, as those of a replay do.
    """
    order = W.partitionBy(*PLACE).orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    seen = ranges.select(*PLACE, F.max("last").over(order).alias("before"), F.col("first").alias("after"))
    return _runs(seen)


def short_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges with fewer ``records`` than offsets: something is missing inside them."""
    missing = F.col("last") - F.col("first") + 1 - F.col("records")
    return ranges.withColumn("missing", missing).filter("missing > 0")


def _runs(steps: DataFrame) -> DataFrame:
    return steps.filter("after - before > 1").select(
        *PLACE,
        (F.col("before") + 1).alias("first_missing"),
        (F.col("after") - 1).alias("last_missing"),
        (F.col("after") - F.col("before") - 1).alias("missing"),
    )
