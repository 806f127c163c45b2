"""Choosing a label from scored labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions.text import is_blank, text_array

UNKNOWN = "unknown"


def top_label(labels: Column, scores: Column, threshold: float = rules.LABEL_THRESHOLD) -> Column:
    """The best-scored label; the first of equal ones; unknown below the threshold."""
    best = F.array_max(scores)
    label = F.element_at(labels, F.array_position(scores, best).cast("int"))
    return F.when(best >= F.lit(threshold), label).otherwise(F.lit(UNKNOWN))


def label_id(label: Column, labels: Sequence[str] = tuple(rules.REJECTION_LABELS)) -> Column:
    """The position of a label in its list; null for a label not in it."""
    return F.nullif(F.array_position(text_array(labels), label), F.lit(0)) - 1


def id_label(position: Column, labels: Sequence[str] = tuple(rules.REJECTION_LABELS)) -> Column:
    return F.get(text_array(labels), position.cast("int"))


def unless_blank(text: Column, label: Column) -> Column:
    """Blank text is unknown and never reaches the model."""
    return F.when(is_blank(text), F.lit(UNKNOWN)).otherwise(label)
