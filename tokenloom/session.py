"""Session settings and durable materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes a scan partition holds at most by default.
SCAN_BYTES = 128 * 1024 * 1024


def get_spark(app: str = "tokenloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Planner settings the operators count on.

    Steps of a sample are partitioned by ``sample_id`` alone. A join on
    ``(sample_id, step)`` may then reuse that partitioning instead of moving the wide
    logit rows again.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a ``local`` master, whose driver is its only executor, gets a temporary folder
    where none is named. A cluster without one is an error: each executor would write to
    its own disk.
    """
    jsc = spark.sparkContext._jsc.sc()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = jsc.getCheckpointDir()
    if current.isEmpty():
        if not configured and re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tokenloom-"))
        current = jsc.getCheckpointDir()
    return configured or current.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for a table a job derives."""
    return f"{shared_dir(spark).rstrip('/')}/tokenloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint; partitions keep their numbers."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_by(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key`` and read it back.

    A checkpoint forgets how its rows are placed. A bucketed table does not, so later joins
    and groupings by ``key`` read wide rows where they lie. Rows already partitioned by
    ``key`` are written without a shuffle. The catalogue entry is needed only until the
    files are resolved; dropping it leaves an external table's files in place.
    """
    spark = df.sparkSession
    name = f"tokenloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").bucketBy(buckets, key)
    writer.option("path", scratch_path(spark, "buckets")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input over all cores before heavy work per row.

    Only where the whole input is smaller than one scan partition per core, so that a scan
    cannot keep the cores busy. A large input is left where it is: it has splits enough.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * SCAN_BYTES else df
