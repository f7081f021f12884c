"""Metrics of a run, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_samples(df: DataFrame, max_train_samples: int | None = None) -> DataFrame:
    """One row: how many samples a run uses."""
    n = F.count("*")
    if max_train_samples is not None:
        n = F.least(n, F.lit(max_train_samples).cast("long"))
    return df.agg(n.alias("train_samples"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)
