"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame, column: str = "text") -> Column:
    """The text column; null reads as empty."""
    return F.coalesce(docs[column], F.lit(""))


def store(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back.

    This cuts the lineage: a lost executor costs no recomputation of ``df``.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_if_small(
    df: DataFrame, row_bytes: int = 64, most_bytes: int = 32 << 20, rows: int | None = None
) -> DataFrame:
    """``df``, marked for broadcast if its counted rows fit; else for a shuffle.

    The results are the same. ``df`` is counted unless ``rows`` says how many
    it may have, so it should be stored.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df.hint("merge")


def shuffle_if_large(
    df: DataFrame, row_bytes: int = 64, most_bytes: int = 8 << 20, rows: int | None = None
) -> DataFrame:
    """``df``, marked for a shuffle join if its counted rows don't fit a broadcast; else left to Spark.

    Spark takes a table for as large as its compressed files, and does not see
    the rows that an explode adds: by that size it may broadcast far too much.
    Counts are as in ``broadcast_if_small``; the larger side of a join is the one to give.
    """
    rows = df.count() if rows is None else rows
    return df if rows * row_bytes <= most_bytes else df.hint("merge")


def running_total(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with column ``name``: the sum of ``weight`` over all rows before, in the order of ``order``.

    Rows are dealt by ranges of ``order``, summed within their range, and moved
    on by the totals of the ranges before: one row a task reaches the driver.
    No two rows should agree in ``order``. The ranges are written first, so a
    task that runs again finds the same ones. Nulls come first; no rows, none.
    """
    part, base = fresh(df, "range_"), fresh(df, "base_")
    dealt = store(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = sorted(dealt.groupBy(part).agg(F.sum(weight)).collect())
    starts = [sum(s for _, s in sums[:k]) for k in range(len(sums))]
    rows = [(p, start) for (p, _), start in zip(sums, starts, strict=True)]
    # At most one row of two numbers for each shuffle partition.
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, f"{part} int, {base} long"))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col(base)
    return dealt.join(offsets, part).withColumn(name, before.cast("long")).drop(part, base)


def text_slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to ``most_bytes`` bytes in column ``text``, or one row: a text is never cut."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
