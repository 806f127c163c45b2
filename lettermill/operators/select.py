"""Choosing rows: unread mail, unseen ids, newest rows, retention, first deliveries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions.text import pin


def recent_unread(
    mails: DataFrame,
    asof: dt.date | dt.datetime,
    days: int = 10,
    cap: int = 1000,
    uid: str = "uid",
    received_at: str = "received_at",
) -> DataFrame:
    """Unread mail of the last days: the newest ``cap``, oldest of them first.

    The cutoff is a literal against the bare column, so it reaches the scan.
    """
    cutoff = (asof - dt.timedelta(days=days)).isoformat()
    unread = mails.filter(~F.col("is_read") & (F.col(received_at) >= cutoff))
    return unread.orderBy(F.desc(uid)).limit(cap).orderBy(uid)


def oldest_unread(
    mails: DataFrame,
    cap: int = 50,
    order: Sequence[str] = ("received_at", "uid"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first ``cap`` unread mails by arrival, projected."""
    unread = mails.filter(~F.col("is_read"))
    if columns is not None:
        unread = unread.select(*columns)
    return unread.orderBy(*order).limit(cap)


def unseen(mails: DataFrame, processed: DataFrame, uid: str = "uid") -> DataFrame:
    """Mail whose id is not in the processed ids.

    The ids are made distinct first, so repeats of one id cannot pile up on
    that side; a busy id on the mail side is split by adaptive execution,
    which may split the left side of an anti join.
    """
    return mails.join(processed.select(uid).distinct(), uid, "left_anti")


def missing_specs(specs: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Specifications whose name is not yet in the inventory."""
    return specs.join(existing.select(name).distinct(), name, "left_anti")


def latest(df: DataFrame, rows: int, *order: Column) -> DataFrame:
    """The newest rows: each task keeps only its own best before they meet."""
    return df.orderBy(*order).limit(rows)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rows: int,
    salt_on: str,
    salts: int = 64,
) -> DataFrame:
    """The first ``rows`` of each group, in two steps.

    A group may hold a third of the table. It is first cut into salted slices,
    each ranked apart (and limited before the shuffle by Spark's window group
    limit); only the survivors, at most ``rows * salts``, meet in one task.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    slices = W.partitionBy(*keys, "__salt").orderBy(*order)
    groups = W.partitionBy(*keys).orderBy(*order)
    first = salted.withColumn("__rank", F.row_number().over(slices)).filter(
        F.col("__rank") <= rows
    )
    return (
        first.withColumn("__rank", F.row_number().over(groups))
        .filter(F.col("__rank") <= rows)
        .drop("__rank", "__salt")
    )


def first_delivery(
    events: DataFrame, key: str = "event_id", order: Sequence[str] = ("received_at",)
) -> DataFrame:
    """One row per key: the first by ``order``. Rows without a key all stay.

    Spark limits each task to one row per key before the shuffle, so many
    copies of one event shrink to one per task. Rows without a key get one of
    their own, so the table is read and its keys are worked out once.
    """
    pinned = pin(events, key, F.col(key)).withColumn("__row", F.monotonically_increasing_id())
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.col("__row").cast("string")))
    # A key that looks like a row's stand-in is told apart by whether there is one.
    keyed = pinned.withColumn("__own", own).withColumn("__none", F.col(key).isNull())
    window = W.partitionBy("__own", "__none").orderBy(*order)
    first = keyed.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1")
    return first.select(*events.columns)


def retain(df: DataFrame, column: str, days: int, asof: dt.date) -> DataFrame:
    """Rows not older than ``days``; on a table partitioned by ``column`` whole partitions go."""
    return df.filter(F.col(column) >= F.lit((asof - dt.timedelta(days=days)).isoformat()))


def retain_by_topic(
    records: DataFrame,
    column: str,
    asof: dt.date,
    specs: Sequence[tuple] = tuple(rules.TOPIC_SPECS),
) -> DataFrame:
    """Each topic's own retention; records of a topic without one are kept.

    Plain comparisons of the bare columns, which reach the scan.
    """
    if not specs:
        return records
    topic = F.col("topic")
    other = ~topic.isin(*[name for name, _, _, _ in specs])
    keep = topic.isNull() | other
    for name, _, _, days in specs:
        cutoff = (asof - dt.timedelta(days=days)).isoformat()
        keep = keep | ((topic == name) & (F.col(column) >= cutoff))
    return records.filter(keep)
