"""Running a Python model over a column, loaded once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F


def model_column(load: Callable[[], Any], apply: Callable[[Any, pd.Series], Any], return_type: str):
    """A column function that loads a model, then maps Arrow batches of text.

    ``return_type`` is ``struct<labels:array<string>,scores:array<double>>`` for
    a scorer and ``array<string>`` for an entity finder. ``load`` runs once per
    task; a loader that caches in its own module runs once per worker.
    """

    if return_type.startswith("struct"):

        @F.pandas_udf(return_type)
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for texts in batches:
                yield apply(model, texts)

        return scored

    @F.pandas_udf(return_type)
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield apply(model, texts)

    return mapped
