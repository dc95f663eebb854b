"""g02: a user's own model as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def verdict(load: Callable[[], Callable[[pd.Series], pd.Series]], returns: str = "double"):
    """A function of a text column. `load` runs once a task and gives what maps a batch of texts to their verdicts, so a model is
    read once, not with every batch. Nulls reach the model as they are."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts)

    return F.pandas_udf(run, returns)
