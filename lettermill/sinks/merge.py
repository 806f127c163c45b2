"""A table with one row per event, into which batches and backfills are merged.

Rows lie in hash buckets of their key. A merge writes the buckets it touches
anew beside the old ones and then publishes a version, a small file that names
the folder of every bucket. Readers see one version whole; a merge that dies
leaves nothing but folders no version names. Two merges at a time may both do
their work, but only one can publish the next version: the other one begins
again on top of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill import storage

BUCKETS = 64


@dataclass(frozen=True)
class Version:
    """What one version of the table holds: the folder and the rows of every bucket that has any."""

    number: int
    folders: dict[int, str]
    rows: dict[int, int]
    batches: dict[str, int]

    @property
    def count(self) -> int:
        return sum(self.rows.values())


EMPTY = Version(0, {}, {}, {})


@dataclass
class MergeTable:
    """The table at ``path``; ``key`` tells rows apart. Keep ``buckets`` as it was when the table began.

    A merge reads and writes a share of the table: about the buckets its keys fall
    into. Choose the number so that a bucket is a few files' worth of rows.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str = "event_id"
    buckets: int = BUCKETS

    def version(self) -> Version:
        """The newest version."""
        numbers = [int(name.removesuffix(".json")) for name in storage.names(self.spark, f"{self.path}/versions")]
        if not numbers:
            return EMPTY
        found = json.loads(storage.read_text(self.spark, self._version_path(max(numbers))))
        folders = {int(b): f for b, f in found["folders"].items()}
        return Version(max(numbers), folders, {int(b): n for b, n in found["rows"].items()}, found["batches"])

    def _version_path(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        version = self.version() if version is None else version
        return self._rows(version, list(version.folders))

    def _rows(self, version: Version, buckets: Sequence[int]) -> DataFrame:
        paths = [f"{self.path}/data/{version.folders[b]}" for b in buckets if b in version.folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, order: Sequence[Column], run_id: str | None = None, batch_id: int = -1) -> Version:
        """Put ``rows`` in: a row takes the place of one with its key; of several in ``rows`` the first by ``order``.

        Rows without a key are all added. With ``run_id``, the batches of a run must come in the order of
        ``batch_id``, and one that is already in is not put in again. ``rows`` is read several times: keep it.
        """
        columns = [F.col(f"`{name}`") for name in self.schema.names]
        keyed = rows.select(*columns, *[c.alias(f"__order{k}") for k, c in enumerate(order)])
        order = [F.col(f"__order{k}") for k in range(len(order))]
        # Each task keeps one row a key before rows move.
        first = Window.partitionBy(self.key).orderBy(*order)
        named = keyed.filter(F.col(self.key).isNotNull()).withColumn("__rank", F.row_number().over(first))
        named = named.filter("__rank = 1").select(*columns)
        new = named.unionByName(keyed.filter(F.col(self.key).isNull()).select(*columns))
        new = new.withColumn("__bucket", F.coalesce(self.bucket(F.col(self.key)), F.lit(0)))
        # At most one row for each bucket.
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())
        if not touched:
            return self.version()
        while True:
            base = self.version()
            if run_id is not None and base.batches.get(run_id, -1) >= batch_id:
                return base
            found = self._publish(base, new, touched, run_id, batch_id)
            if found is not None:
                return found

    def _publish(self, base: Version, new: DataFrame, touched: list[int], run_id: str | None, batch_id: int) -> Version | None:
        """Write the touched buckets on top of ``base``; None if another version came in between."""
        old = self._rows(base, touched)
        kept = old.join(new.select(F.col(self.key).alias("__key")).filter("__key IS NOT NULL"), F.col(self.key) == F.col("__key"), "left_anti")
        kept = kept.withColumn("__bucket", F.coalesce(self.bucket(F.col(self.key)), F.lit(0)))
        folder = f"version={base.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/data/{folder}"
        # Rows without a key may be many, and all lie in one bucket: they are spread by a number.
        spread = F.when(F.col(self.key).isNull(), F.monotonically_increasing_id() % 64).otherwise(F.lit(0))
        after = kept.unionByName(new).withColumn("__bucket_folder", F.col("__bucket"))
        after.repartition("__bucket", spread).write.partitionBy("__bucket_folder").parquet(path)
        counts = dict(self.spark.read.parquet(path).groupBy("__bucket").count().collect())
        folders, rows = dict(base.folders), dict(base.rows)
        for b in touched:
            folders[b], rows[b] = f"{folder}/__bucket_folder={b}", counts.get(b, 0)
        batches = dict(base.batches)
        if run_id is not None:
            batches[run_id] = batch_id
        version = Version(base.number + 1, folders, rows, batches)
        text = json.dumps({"folders": version.folders, "rows": version.rows, "batches": version.batches})
        published = storage.put_if_absent(self.spark, self._version_path(version.number), text)
        return version if published else None

    def clean(self, keep: int = 1) -> int:
        """Remove versions before the last ``keep`` and the folders only they name; returns the folders removed.

        Run it while no merge is under way; readers of removed versions fail.
        """
        names = sorted(storage.names(self.spark, f"{self.path}/versions"))
        kept, gone = names[-keep:], names[:-keep]
        used = set()
        for name in kept:
            found = json.loads(storage.read_text(self.spark, f"{self.path}/versions/{name}"))
            used |= set(found["folders"].values())
        for name in gone:
            storage.remove(self.spark, f"{self.path}/versions/{name}")
        removed = 0
        for folder in storage.names(self.spark, f"{self.path}/data"):
            parts = [n for n in storage.names(self.spark, f"{self.path}/data/{folder}") if n.startswith("__bucket_folder=")]
            unused = [p for p in parts if f"{folder}/{p}" not in used]
            for part in unused:
                storage.remove(self.spark, f"{self.path}/data/{folder}/{part}")
            if len(unused) == len(parts):
                storage.remove(self.spark, f"{self.path}/data/{folder}")
            removed += len(unused)
        return removed
