"""Vocabulary maps on disk: a JSON object ``{"<teacher id>": <student id>}``, 0 = unmapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.ordering import global_index

# An entry of the object. Lines are read on their own: one entry each as written here, or
# the whole object as other programs write it.
ENTRY = r'"(-?[0-9]+)"\s*:\s*(-?[0-9]+)'


def read_vocab_map(spark: SparkSession, path: str, zero_is_unmapped: bool = True) -> DataFrame:
    """``vocab_map(src_id, dst_id)``; 0 becomes NULL."""
    parts = [F.regexp_extract_all("value", F.lit(ENTRY), F.lit(k)).alias(name) for k, name in ((1, "src"), (2, "dst"))]
    pairs = spark.read.text(path).select(F.explode(F.arrays_zip(*parts)).alias("e"))
    dst = F.col("e.dst").cast("int")
    return pairs.select(
        F.col("e.src").cast("int").alias("src_id"),
        (F.when(dst != 0, dst) if zero_is_unmapped else dst).alias("dst_id"),
    )


def write_vocab_map(mapping: DataFrame, path: str) -> None:
    """The JSON object in part files, ids ascending, unmapped as 0, one entry per line.

    The files one after the other are the object; each is written by its own task from its
    range of ids, so a map has no size limit.
    """
    rows = mapping.count()
    if rows == 0:
        mapping.sparkSession.range(1).select(F.lit("{}").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    numbered = global_index(mapping.select("src_id", F.coalesce("dst_id", F.lit(0)).alias("dst_id")), ["src_id"], "place")
    entry = F.concat(F.lit('"'), F.col("src_id"), F.lit('":'), F.col("dst_id"))
    first = F.when(F.col("place") == 0, "{").otherwise("")
    last = F.when(F.col("place") == rows - 1, "}").otherwise(",")
    numbered.select(F.concat(first, entry, last).alias("value")).write.mode("overwrite").text(path)
