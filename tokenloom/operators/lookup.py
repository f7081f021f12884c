"""Joins of a large table to a vocabulary or id map."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialize

# Measured bytes of a vocabulary or map that may be broadcast: all values as text, and 16 each.
BROADCAST_BYTES = 96 * 1024 * 1024
HOT_ROWS = 1_000_000  # rows of one key that a single task may read


def measured_bytes(dim: DataFrame) -> int:
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in dim.columns), F.lit(0))
    return dim.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    how: str = "left",
    salt_by: list[str] | None = None,
    salts: int = 32,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``df`` to ``dim``, which holds one row per key.

    The bytes of ``dim`` are measured. Up to ``broadcast_bytes`` it is broadcast and ``df``
    does not move. Beyond that both sides are shuffled on the key. The keys with more than
    ``hot_rows`` rows are counted out first: their rows are dealt over ``salts`` tasks, and
    only theirs are repeated in ``dim``, so a token that fills a third of ``df`` is spread and
    every other entry moves once. No row is lost either way.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if measured_bytes(dim) <= broadcast_bytes:
        return df.join(F.broadcast(dim), keys, how)
    by = salt_by or [c for c in df.columns if c not in keys][:2] or keys
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot")))
    missing = reduce(or_, (F.col(k).isNull() for k in keys))
    salt = F.when(F.col("_hot") | missing, F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(0).cast("int")
    left = df.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    each = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(0))
    right = dim.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
