"""Row numbers, splits, limits and shuffles by an explicit, unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.constants import DEFAULT_SEED, DEFAULT_VALIDATION_PERCENT
from tokenloom.session import materialize

_OFFSET_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: place in its partition


def global_index(df: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Number all rows from 0 in ``order``, which must be a total order.

    The range-sorted rows are checkpointed, which pins them to partitions. A row's number
    is its place in its partition plus the sizes of the partitions before it; the only
    window without a key runs over one row per partition.
    """
    placed = (
        materialize(df.orderBy(*order))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_OFFSET_BITS)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg((F.max("_place") + 1).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_place")).alias(name)
    )


def percent_split(
    df: DataFrame, key: str, percent: float = DEFAULT_VALIDATION_PERCENT
) -> DataFrame:
    """Add ``split``: the first ``percent`` % of rows by ``key`` are ``validation``.

    Only the key is sorted. The rows themselves are filtered against one boundary value
    and do not move.
    """
    ranks = global_index(df.select(key), [key])
    size = F.bround(F.lit(percent) * ranks.agg(F.count("*").alias("n")).scalar() / F.lit(100.0))
    last = ranks.filter(F.col("idx") < size).agg(F.max(key).alias("last")).scalar()
    return df.withColumn("split", F.when(F.col(key) <= last, "validation").otherwise("train"))


def take_first(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def shuffle_key(key: str, seed: int = DEFAULT_SEED) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def seeded_shuffle(df: DataFrame, key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """A permutation that depends on the key and the seed alone."""
    return df.orderBy(shuffle_key(key, seed), key)


def shuffled_index(df: DataFrame, key: str, seed: int = DEFAULT_SEED, name: str = "idx") -> DataFrame:
    """The place of every row in ``seeded_shuffle``."""
    keyed = df.withColumn("_shuffle", shuffle_key(key, seed))
    return global_index(keyed, ["_shuffle", key], name).drop("_shuffle")


def buffer_shuffle(
    df: DataFrame, key: str, buffer: int, seed: int = DEFAULT_SEED, name: str = "idx"
) -> DataFrame:
    """Shuffle inside consecutive blocks of ``buffer`` rows; adds the new place.

    After the numbering a block holds at most ``buffer`` rows, so the window is bounded.
    """
    numbered = global_index(df, [key], "_row").withColumn("_block", F.floor(F.col("_row") / buffer))
    inside = Window.partitionBy("_block").orderBy(shuffle_key(key, seed), key)
    place = F.col("_block") * buffer + F.row_number().over(inside) - 1
    return numbered.withColumn(name, place.cast("long")).drop("_row", "_block")


def drop_source_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep)
