"""Texts from templates (x30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(df: DataFrame, intent: Column, templates: list[tuple], parts: list[str], names: list[str], fallback: str) -> DataFrame:
    """Adds a text column for each of `parts`. templates: rows of intent and one text a part; `{name}` in it stands for the column of
    that name (null: nothing). Unknown and null intents take the template of `fallback`. Values are not searched for names
    that come before theirs."""
    known = [t[0] for t in templates]
    rules = df.sparkSession.createDataFrame([tuple(t) for t in templates], ", ".join(f"{c} string" for c in ["_intent", *[f"_{p}" for p in parts]]))
    rows = df.withColumn("_intent", F.when(intent.isin(known), intent).otherwise(fallback)).join(F.broadcast(rules), "_intent")
    for part in parts:
        text = F.col(f"_{part}")
        for n in names:
            text = F.replace(text, F.lit(f"{{{n}}}"), F.coalesce(F.col(n).cast("string"), F.lit("")))
        rows = rows.withColumn(part, text)
    return rows.drop("_intent", *[f"_{p}" for p in parts])
