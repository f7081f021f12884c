"""Labels, masks and positions of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.constants import IGNORE_INDEX
from tokenloom.functions import arrays


def truncate(ids: Column, block_size: int) -> Column:
    return F.slice(ids, 1, block_size)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.lit(1))


def mask_prompt_labels(ids: Column, prompt_length: Column) -> Column:
    """A copy of ids whose first ``prompt_length`` entries are ignored."""
    return arrays.let(
        prompt_length,
        lambda n: F.transform(ids, lambda x, i: F.when(i < n, F.lit(IGNORE_INDEX)).otherwise(x)),
    )


def overlength(raw_ids: Column, block_size: int) -> Column:
    return F.size(raw_ids) > block_size


def position_ids(ids: Column) -> Column:
    """0 .. n-1 per sample (the intended meaning)."""
    return F.transform(ids, lambda x, i: i.cast("int"))


def is_content(label: Column) -> Column:
    return label != IGNORE_INDEX


def content_positions(df: DataFrame, ids: str = "ids", labels: str = "labels") -> DataFrame:
    """One row ``(.., pos, token_id)`` per labelled position."""
    rest = [c for c in df.columns if c not in (ids, labels)]
    pairs = F.arrays_zip(F.col(ids).alias("id"), F.col(labels).alias("label"))
    return (
        df.select(*rest, F.posexplode(pairs).alias("pos", "_e"))
        .filter(is_content(F.col("_e.label")))
        .select(*rest, "pos", F.col("_e.id").alias("token_id"))
    )


def response_start(labels: Column, pad_id: int | None = None) -> Column:
    """First index with a label, then the first one from there that is not padding."""
    indexed = F.transform(labels, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(indexed, lambda e: e["x"] != IGNORE_INDEX)
    if pad_id is None:
        return F.get(kept, F.lit(0))["i"]
    first = F.get(kept, F.lit(0))["i"]
    return arrays.let(
        first,
        lambda s: F.get(F.filter(indexed, lambda e: (e["i"] >= s) & (e["x"] != pad_id)), F.lit(0))["i"],
    )


def rotate_to_response(values: Column, start: Column) -> Column:
    return arrays.rotated(values, start)


def rotated_position(df: DataFrame, keys: list[str], label: str = "label", pad_id: int | None = None) -> DataFrame:
    """Step-table form of the rotation: adds ``rpos`` to rows ``(keys, pos, label)``.

    The window is one side of one sample, at most a block of steps. Rows are placed by
    the first key alone, the sample, so a later join of its two sides finds them in place.
    """
    group = Window.partitionBy(*keys)
    labelled = F.min(F.when(is_content(F.col(label)), F.col("pos"))).over(group)
    marked = df.repartition(keys[0]).withColumn("_start", labelled)
    if pad_id is not None:
        real = F.when((F.col("pos") >= F.col("_start")) & (F.col(label) != pad_id), F.col("pos"))
        marked = marked.withColumn("_start", F.min(real).over(group))
    length = F.count(F.lit(1)).over(group)
    return marked.withColumn(
        "rpos", F.pmod(F.col("pos") - F.col("_start"), length).cast("int")
    ).drop("_start")
