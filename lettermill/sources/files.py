"""Labelled texts and written output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill import rules, schemas


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``text`` and ``label``."""
    return spark.read.schema(schemas.LABELLED_TEXT).json(path)


def split_known_labels(
    labelled: DataFrame, labels: Sequence[str] = tuple(rules.REJECTION_LABELS)
) -> tuple[DataFrame, DataFrame]:
    """Rows with a known label, and the rest, which must not end the job."""
    known = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    return labelled.filter(known), labelled.filter(~known)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines below a path; 0 where nothing was written yet."""
    try:
        return spark.read.option("recursiveFileLookup", "true").text(path).count()
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return 0
