"""Bounded samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import store, whole_text


def is_held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def least_hashed(rows: DataFrame, column: str, most: int, *then: str) -> DataFrame:
    """The ``most`` rows with the smallest 64-bit hashes in ``column``, ties in the order of ``then``.

    The rows are counted, and those far above the bound that is to be expected
    go before the ordering: else every task would hand ``most`` rows to the last
    one. Twice the rows needed are expected to be left, so none is missed.
    """
    n = rows.count()
    if n > 4 * most:
        rows = rows.filter(F.col(column) < -(1 << 63) + (1 << 64) * 2 * most // n)
    return rows.orderBy(column, *then).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``label`` and ``text`` of at most ``most`` documents that may be learned from.

    ``labels`` has ``doc_id`` and ``label``. The documents are those whose ids
    have the smallest hashes, the same for the same tables. Of several labels
    of an id the largest counts, of several texts the smallest; rows without
    an id or a label, and held-out ids, are left out.
    """
    rated = (
        labels.select("doc_id", "label")
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~is_held_out(F.col("doc_id")))
        .join(docs.select(docs["doc_id"].alias("doc_id")).distinct(), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    rated = store(rated.withColumn("hash", F.xxhash64("doc_id")), "rated")
    chosen = least_hashed(rated, "hash", most, "doc_id").drop("hash")
    texts = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text"))
    # At most ``most`` rows of two numbers.
    met = texts.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
