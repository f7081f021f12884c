"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import scratch_path

# A table is broadcast only where its measured text and number bytes stay below this.
BROADCAST_BYTES = 16 * 1024 * 1024
SALTS = 32

# A word is a run of anything but these: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, lengthened where the caller's table already has such a column."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return df["`" + name.replace("`", "``") + "`"]


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a fixed table for later steps."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a table: rows, and the bytes of all its values as text."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16 * len(df.columns)))
    size = df.agg(F.sum(width).alias("bytes")).first()[0]
    return (size or 0) <= limit


def attach(df: DataFrame, dim: DataFrame, keys: list[str], salt_by: list[str], how: str = "left") -> DataFrame:
    """Join ``df`` to ``dim``, which has one row per combination of ``keys``; null equals null.

    ``dim`` is measured and broadcast where it is small. Otherwise both sides are shuffled by
    the keys and a salt hashed from ``salt_by``, so that one key with a third of the rows is
    spread over ``SALTS`` tasks. Both ways give the same rows.
    """
    (salt,) = fresh([*df.columns, *dim.columns], "salt")
    renamed = dict(zip(keys, fresh([*df.columns, *dim.columns, salt], *(f"{k}_right" for k in keys))))
    right = dim.withColumnsRenamed(renamed)
    same = [df[k].eqNullSafe(right[r]) for k, r in renamed.items()]
    if fits_broadcast(dim):
        return df.join(F.broadcast(right), same, how).drop(*renamed.values())
    left = df.withColumn(salt, F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    right = right.withColumn(f"{salt}_right", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [left[k].eqNullSafe(right[r]) for k, r in renamed.items()]
    joined = left.join(right, [*same, left[salt] == right[f"{salt}_right"]], how)
    return joined.drop(salt, f"{salt}_right", *renamed.values())


def without_keys(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are not in ``dropped``; null equals null.

    ``dropped`` is measured: a small one is broadcast and ``df`` stays where it is, a large
    one is joined by a shuffle.
    """
    dropped = stored(dropped.select(*keys).distinct(), "dropped")
    names = fresh([*df.columns, *keys], *(f"{k}_dropped" for k in keys))
    right = dropped.toDF(*names)
    same = [df[k].eqNullSafe(right[n]) for k, n in zip(keys, names)]
    return df.join(F.broadcast(right) if fits_broadcast(dropped) else right, same, "left_anti")


def keyed_fraction(seed: int, *keys: str) -> Column:
    """A number in [0, 1) hashed from the seed and the keys, the same on every run."""
    parts = [F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
