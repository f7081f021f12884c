"""Mix sources to target weights: repetition rates per source, whole copies plus one drawn copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import WORD, attach, fresh, keyed_fraction, stored
from tokenloom.operators.ordering import global_index

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    source: str,
    size: str,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``(source, source_size, target)`` for every source.

    Sources in code point order, null last, take the weights in turn, repeating. Together
    they get ``share`` times all sizes in proportion to their weights, but none more than
    ``most`` times its own size; what is over goes to the others by weight until none is
    above. Rows are summed before they are shuffled, so a source with a third of all rows
    is as cheap as any other. The level of the shares is found by rounds over the table of
    sources, of which only two sums reach the driver; each round caps one source more at
    least, and few rounds are needed.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ranked = global_index(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("most")), "sources")
    level = _level(sources, share)
    target = F.least(F.lit(level) * F.col("weight"), F.col("most"))
    return sources.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _level(sources: DataFrame, share: float) -> float:
    """The number whose product with the weights, cut at each source's most, sums to the share."""
    whole, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole:
        return 0.0
    wanted, level, capped = share * whole, share * whole / weights, 0
    while True:
        above = F.lit(level) * F.col("weight") > F.col("most")
        n, taken, rest = sources.agg(
            F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == capped or not rest:
            return level if rest else float("inf")
        capped, level = n, (wanted - taken) / rest


def mix_plan(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    seed: int = 0,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to every row.

    A source's rate is its target over its size. Each row gets ``floor(rate)`` copies, and
    one more if a number hashed from the seed and its key is below the fraction. So no row
    gets more copies than the greatest rate rounded up, and a rerun gives the same copies.
    ``targets`` is the table of ``source_targets``; by default it is made from ``size``. A
    null source is a source; a null size counts as 0; rows that repeat a key are drawn
    alike; an empty table gives an empty table. Columns that clash get an underscore.
    """
    if targets is None:
        targets = source_targets(docs, source, size)
    whole, target, copies, own = fresh(docs.columns, "source_size", "target", "copies", "own_source")
    joined = attach(docs.withColumn(own, F.col(source)), targets.toDF(own, whole, target), [own], [key]).drop(own)
    rate = F.coalesce(F.try_divide(F.col(target), F.col(whole)), F.lit(0.0))
    drawn = (keyed_fraction(seed, key) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(copies, F.floor(rate) + drawn)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """The mixed corpus: every row as often as ``mix_plan`` says, with its own columns only.

    Sizes are the words of the whole texts, summed per source first.
    """
    (size,) = fresh(docs.columns, "size")
    sizes = docs.select(F.col(source), word_count(text).alias(size))
    copies, copy = fresh(docs.columns, "copies", "copy")
    planned = mix_plan(docs, key, source, seed=seed, targets=source_targets(sizes, source, size))
    return planned.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
