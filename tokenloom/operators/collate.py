"""Batches, padding and random masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.constants import (
    DEFAULT_SEED,
    IGNORE_INDEX,
    MLM_PROBABILITY,
    PAD_MULTIPLE,
    PAD_TOKEN,
)
from tokenloom.functions.arrays import padded
from tokenloom.functions.text import unit_hash
from tokenloom.operators.ordering import shuffled_index


def assign_batches(df: DataFrame, key: str, batch_size: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``(key, batch)``: consecutive rows of the seeded shuffle share a batch."""
    numbered = shuffled_index(df.select(key), key, seed)
    return numbered.select(key, F.floor(F.col("idx") / batch_size).cast("long").alias("batch"))


def pad_batch(
    tokens: DataFrame,
    batches: DataFrame,
    key: str,
    pad_id: int,
    multiple: int = PAD_MULTIPLE,
    side: str = "left",
) -> DataFrame:
    """Pad ``ids``, ``mask`` and ``labels`` to the width of their batch.

    ``tokens`` is read once: rows are gathered by batch, and a window over a batch, which
    has a set number of rows, gives its width.
    """
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    placed = tokens.join(batches, key).withColumn("_width", F.ceil(longest / F.lit(float(multiple))) * multiple)
    width = F.col("_width").cast("int")
    return placed.select(
        key,
        "batch",
        padded(F.col("ids"), width, pad_id, side).alias("ids"),
        padded(F.col("mask"), width, 0, side).alias("mask"),
        padded(F.col("labels"), width, IGNORE_INDEX, side).alias("labels"),
    )


def pad_teacher(tokens: DataFrame, batches: DataFrame, key: str, pad_id: int, side: str = "right") -> DataFrame:
    """Teacher side: to the longest of the batch, without rounding."""
    return pad_batch(tokens, batches, key, pad_id, multiple=1, side=side)


def pad_token_default(pad: Column, eos: Column, student: bool) -> Column:
    """A student without a pad token gets its own, a teacher reuses its end marker."""
    return F.coalesce(pad, F.lit(PAD_TOKEN)) if student else F.coalesce(pad, eos)


def mlm_mask(
    df: DataFrame,
    key: str,
    mask_id: int,
    vocab_size: Column | int,
    special_ids: list[int] | None = None,
    probability: float = MLM_PROBABILITY,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Random masking of ``ids``: label where chosen, else ignored.

    A chosen token becomes the mask in 8 of 10 cases and a random one in 1 of 10. The
    draws are hashes of (key, position, seed), so a recomputed task draws the same.
    """
    df = df.withColumn("_size", F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size)

    def draw(i: Column, name: str) -> Column:
        return unit_hash(F.col(key), i, F.lit(seed), F.lit(name))

    def entry(x: Column, i: Column) -> Column:
        chosen = draw(i, "pick") < probability
        if special_ids:
            chosen = chosen & ~x.isin(special_ids)
        how = draw(i, "how")
        other = F.floor(draw(i, "id") * F.col("_size")).cast("int")
        swapped = F.when(how < 0.8, F.lit(mask_id)).when(how < 0.9, other).otherwise(x)
        return F.struct(
            F.when(chosen, swapped).otherwise(x).alias("id"),
            F.when(chosen, x).otherwise(F.lit(IGNORE_INDEX)).alias("label"),
        )

    drawn = df.withColumn("_drawn", F.transform("ids", entry))
    return drawn.withColumns(
        {
            "ids": F.transform("_drawn", lambda e: e["id"]),
            "labels": F.transform("_drawn", lambda e: e["label"]),
        }
    ).drop("_drawn", "_size")
