"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "lettermill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the time zone pinned to UTC.

    Give ``spark.sql.shuffle.partitions`` a few partitions per core of the
    cluster: adaptive execution merges small ones and splits skewed ones, but
    never makes more. A stream that drops repeats keeps the count it began with.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Messages and pages vary in size: bound what one Arrow batch holds.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def state_session(spark: SparkSession, per_core: int = 2) -> SparkSession:
    """A session for a stream with state, with state partitions to match the cores.

    Each batch opens every state partition, and their number stays what it was
    when the stream first started.
    """
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.checkpoint.dir"):
        value = spark.conf.get(key, None)
        if value is not None and session.conf.isModifiable(key):
            session.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.shuffle.partitions", str(per_core * cores))
    return session


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="lettermill-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
