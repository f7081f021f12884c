"""The nearest token of another vocabulary by edit distance, exactly, without comparing all pairs.

A task keeps the target tokens sorted from both ends, with a mark of the letters of each
(``functions.trie``). For growing radii, a word is compared with the tokens that begin or end
nearly like it and whose marks allow the radius; a word far from all tokens meets them in the
order of the bounds that the marks give. A vocabulary of measured, bounded size is broadcast, and
words stay where they are. A larger one is dealt into blocks of that size; words meet every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.trie import Bands
from tokenloom.session import materialize

# Bytes of tokens (and 12 an entry) that a task keeps sorted; while it sorts them they take some tens of times as much.
TRIE_BYTES = 32 * 1024 * 1024
# Words with equal halves are walked once, so many words at a time cost less each.
WORDS_AT_ONCE = 400_000
_FOUND = "src_id int, dst_id int, distance int"


def _nearest(bands: Bands, words: pa.Table) -> pa.Table:
    """The nearest target of ``(src_id, token)``; ``dst_id`` is NULL where there is no target."""
    distances, ids = bands.nearest(words["token"].to_pylist())
    none = distances < 0
    return pa.table(
        {
            "src_id": words["src_id"].cast(pa.int32()),
            "dst_id": pa.array(ids.astype(np.int32), pa.int32(), mask=none),
            "distance": pa.array(distances.astype(np.int32), pa.int32(), mask=none),
        }
    )


def _bands(targets: pa.Table) -> Bands:
    return Bands(targets["token"].to_pylist(), targets["id"].to_pylist())


def min_edit_map(teacher: DataFrame, student: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``(src_id, dst_id, distance)``: the nearest student token, ties by the least id.

    An empty student vocabulary maps every token to NULL.
    """
    spark = teacher.sparkSession
    targets = materialize(student.groupBy("token").agg(F.min("id").cast("int").alias("id")))
    size = targets.agg(F.sum(F.octet_length("token") + F.lit(12)).alias("bytes")).first()["bytes"] or 0
    words = teacher.select(F.col("id").cast("int").alias("src_id"), "token")
    parallel = spark.sparkContext.defaultParallelism
    if size <= trie_bytes:
        shared = spark.sparkContext.broadcast(targets.toArrow())

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands, held = None, []
            for batch in batches:
                bands = bands or _bands(shared.value)
                held.append(batch)
                if sum(b.num_rows for b in held) >= WORDS_AT_ONCE:
                    yield from _nearest(bands, pa.Table.from_batches(held)).to_batches()
                    held = []
            if held:
                yield from _nearest(bands, pa.Table.from_batches(held)).to_batches()

        # Words come sorted by frequency, and rare ones take longer: deal them out anew.
        return words.repartition(parallel, "src_id").mapInArrow(walk, _FOUND)

    def meet(given: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _nearest(Bands([], []), given.slice(0, 0))
        return _nearest(_bands(block), given)

    blocks, rows = -(-size // trie_bytes), words.count()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    salts = max(parallel, -(-rows // WORDS_AT_ONCE))
    left = words.withColumn("salt", dealt("src_id", salts)).withColumn("block", every(blocks))
    right = targets.withColumn("block", dealt("token", blocks)).withColumn("salt", every(salts))
    met = left.groupBy("salt", "block").cogroup(right.groupBy("salt", "block")).applyInArrow(meet, _FOUND)
    best = met.groupBy("src_id").agg(F.min(F.struct("distance", "dst_id")).alias("best"))
    return best.select("src_id", "best.dst_id", "best.distance")
