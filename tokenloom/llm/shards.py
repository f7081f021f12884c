"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniform permutation of all rows, how many rows of a partition end up in a shard is a
multivariate hypergeometric draw. So the counts are drawn first, for every partition and
shard; then each partition permutes its rows and deals them out by its counts, the rows are
exchanged, and each shard permutes what it got. No row is compared with rows elsewhere.

The matrix is never held in one place. Partitions form a binary tree, and every split of a
node's rows between its halves is drawn from a generator seeded by the node. A task walks
down to its own partition and so draws its own row of the matrix, the same on every attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import fresh, stored

PLACE_BITS = 33  # of monotonically_increasing_id: the place of a row in its partition
# Rows of a shard that are permuted together; a shard of any size is many such buckets.
BUCKET_ROWS = 100_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good, for populations of any size.

    The probabilities are summed from the mode outwards over 40 standard deviations, beyond
    which nothing is left that a double could show.
    """
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    whole = good + bad
    mode = (drawn + 1) * (good + 1) // (whole + 2)
    spread = 40 * (drawn * (good / whole) * (bad / whole) * ((whole - drawn) / max(whole - 1, 1))) ** 0.5 + 40
    least, most = max(least, int(mode - spread)), min(most, int(mode + spread))
    at = np.arange(least, most, dtype=np.float64)
    ratios = np.log(good - at) + np.log(drawn - at) - np.log(at + 1) - np.log(bad - drawn + at + 1)
    logs = np.concatenate(([0.0], np.cumsum(ratios)))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return least + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def matrix_row(seed: int, ends: np.ndarray, part: int, sizes: list[int]) -> list[int]:
    """The rows of partition ``part`` that go to each shard; ``ends`` are running row counts."""
    low, high, wanted = 0, len(ends), list(sizes)
    before = np.concatenate(([0], ends))
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left, right = int(before[middle] - before[low]), int(before[high] - before[middle])
        first = []
        for size in wanted:
            taken = draw_hypergeometric(rng, left, right, size)
            first.append(taken)
            left, right = left - taken, right - (size - taken)
        if part < middle:
            high, wanted = middle, first
        else:
            low, wanted = middle, [w - f for w, f in zip(wanted, first)]
    return wanted


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard) to every row.

    Shard sizes are at most one apart. The rows are first written to the shared folder, which
    fixes their places: a lost task reads the same rows again. Only one number per partition
    reaches the driver. A shard is permuted in buckets of about 100,000 rows drawn at
    random, so its size is not bound by a task. Rows are never compared, so nulls, ties,
    repeated rows and empty texts are rows like others; an empty table gives an empty table.
    Other columns are kept; a clashing name gets an underscore.
    """
    shard, slot, row, bucket, start = fresh(docs.columns, "shard", "slot", "row_id", "bucket", "bucket_start")
    placed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    part = F.shiftright(row, PLACE_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    numbers = np.array([c["part"] for c in counts], np.int64)
    ends = np.cumsum(np.array([c["n"] for c in counts], np.int64))
    rows = int(ends[-1]) if len(ends) else 0
    sizes = shard_sizes(rows, shards)

    def dealt(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, labels = -1, np.zeros(0, np.int32)
        for ids in batches:
            ids = ids.to_numpy(zero_copy_only=False)
            out = np.empty(len(ids), np.int32)
            parts = ids >> PLACE_BITS
            for number in np.unique(parts):
                if number != own:
                    own, at = number, int(np.searchsorted(numbers, number))
                    given = np.repeat(np.arange(shards, dtype=np.int32), matrix_row(seed, ends, at, sizes))
                    labels = np.random.Generator(np.random.PCG64([seed, at])).permutation(given)
                here = parts == number
                out[here] = labels[ids[here] & ((1 << PLACE_BITS) - 1)]
            yield pa.array(out, pa.int32())

    deal = F.arrow_udf(dealt, "int", F.ArrowUDFType.SCALAR_ITER)
    buckets = max(1, -(-rows // (shards * BUCKET_ROWS)))
    spread = F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), row), F.lit(buckets)).cast("int")
    to = placed.withColumn(shard, F.coalesce(deal(row), F.lit(0))).withColumn(bucket, spread)
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        to.groupBy(shard, bucket)
        .agg(F.count("*").alias("n"))
        .select(shard, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    )
    inside = Window.partitionBy(shard, bucket).orderBy(F.xxhash64(F.lit(seed), F.lit("slot"), row), row)
    mixed = to.withColumn(slot, F.row_number().over(inside) - 1)
    return mixed.join(starts, [shard, bucket]).select(
        *docs.columns, shard, (F.col(slot) + F.col(start)).cast("long").alias(slot)
    )
