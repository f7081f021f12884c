"""The queries of this folder and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: a batch that goes to Python is bounded in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024))
    return tune(spark)


def query(run: Query) -> Query:
    """Register ``run`` under its own name."""

    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(ready(spark), sf_dir.rstrip("/"))

    tuned.__doc__ = run.__doc__
    QUERIES[run.__name__] = tuned
    return run
