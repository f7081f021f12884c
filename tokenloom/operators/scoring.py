"""Running metrics, accuracies and task scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tokenloom.constants import DEFAULT_LOG_EVERY, RESET_EVERY

METRICS = ("sft_loss", "distill_loss", "unmasked_rate")
LOSSES = ("sft_loss", "distill_loss")
BLOCK_STEPS = 65_536


def _finite(names: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for name in names:
        ok = ok & ~F.isnan(name) & (F.abs(F.col(name)) != F.lit(float("inf")))
    return F.coalesce(ok, F.lit(False))


def guarded(values: tuple[str, ...], guard: bool = True, digits: int | None = None) -> dict[str, Column]:
    """What a row adds to each sum: nothing when ``guard`` is on and a loss is not finite.

    With ``digits`` it is a decimal of so many digits. Sums of decimals are exact, so they are the
    same in any order of the rows; without a guard, what is not finite is left out (``stray``).
    """
    ok = _finite(tuple(n for n in LOSSES if n in values)) if guard else F.lit(True)
    zero = F.lit(0.0)
    if digits is None:
        return {n: F.when(ok, F.coalesce(F.col(n), zero)).otherwise(zero) for n in values}
    return {n: F.when(ok & _finite((n,)), F.col(n)).otherwise(zero).cast(f"decimal(20,{digits})") for n in values}


def stray(values: tuple[str, ...]) -> dict[str, Column]:
    """What a row adds to each sum beside the decimals: its value where that is not finite."""
    return {n: F.when(F.col(n).isNull() | _finite((n,)), F.lit(0.0)).otherwise(F.col(n)) for n in values}


def running_sums(
    metrics: DataFrame, keys: list[str], values: tuple[str, ...], guard: bool = True, block: int = BLOCK_STEPS, digits: int | None = None
) -> DataFrame:
    """``(keys, step, rows, sum_<value>..)``: cumulative counts and sums in order of ``step``.

    A run is cut into blocks of steps: blocks are summed, the sums are accumulated over
    the few blocks, and rows are accumulated inside their block. No task sees a whole run.
    """
    added = {f"_{n}": c for n, c in guarded(values, guard, digits).items()}
    if digits is not None and not guard:
        added |= {f"_{n}_stray": c for n, c in stray(values).items()}
    names = [c.removeprefix("_") for c in added]
    df = metrics.withColumn("_block", F.floor(F.col("step") / block)).withColumns(added)
    sums = df.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"), *[F.sum(f"_{n}").alias(f"_block_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_block_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = {n: (F.col(f"_before_{n}") + F.sum(f"_{n}").over(inside)).cast("double") for n in names}
    return df.join(carried, [*keys, "_block"]).select(
        *keys,
        "step",
        (F.col("_rows_before") + F.count("*").over(inside)).alias("rows"),
        *[(total[n] + total[f"{n}_stray"] if f"{n}_stray" in total else total[n]).alias(f"sum_{n}") for n in values],
    )


def running_mean(
    metrics: DataFrame,
    values: tuple[str, ...] = METRICS,
    guard: bool = True,
    reset_every: int | None = None,
    block: int = BLOCK_STEPS,
    digits: int | None = None,
) -> DataFrame:
    """Cumulative means per ``run`` in order of ``step``.

    With ``guard``, a row whose losses are not finite counts but adds nothing.
    ``reset_every`` starts the sums anew in every bucket of that many steps. ``digits`` makes the
    sums exact for values of so many decimal digits (``guarded``).
    """
    keys = ["run"]
    if reset_every:
        metrics = metrics.withColumn("bucket", reset_bucket(F.col("step"), reset_every))
        keys = ["run", "bucket"]
    sums = running_sums(metrics, keys, values, guard, block, digits)
    return sums.select("run", "step", *[(F.col(f"sum_{n}") / F.col("rows")).alias(n) for n in values])


def reset_bucket(step: Column, every: int = RESET_EVERY) -> Column:
    return F.floor(step / every)


def log_every(metrics: DataFrame, k: int = DEFAULT_LOG_EVERY) -> DataFrame:
    return metrics.filter(F.col("step") % k == 0)


def shifted_accuracy(steps: DataFrame, denominator: str = "all") -> DataFrame:
    """Prediction at a position against the label of the next one.

    ``steps`` is ``(sample_id, pos, pred, label)``. ``all`` divides by every shifted
    position, ignored labels included; ``content`` by those with a label.
    """
    following = Window.partitionBy("sample_id").orderBy("pos")
    shifted = steps.withColumn("_next", F.lead("label").over(following)).filter(F.col("_next").isNotNull())
    hits = F.sum((F.col("pred") == F.col("_next")).cast("int"))
    counted = F.count("*") if denominator == "all" else F.sum((F.col("_next") != -100).cast("int"))
    return shifted.agg(
        hits.cast("long").alias("correct"),
        counted.cast("long").alias("counted"),
        F.try_divide(hits.cast("double"), counted.cast("double")).alias("accuracy"),
    )


def shifted_correct_count(steps: DataFrame) -> DataFrame:
    return shifted_accuracy(steps).select("correct")


def perplexity(mean_loss: Column) -> Column:
    """exp of a mean loss; too large a loss gives infinity."""
    return F.exp(mean_loss)


@F.pandas_udf(IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays.

    Row i of the table is held as one big integer: a bit is 0 where the length grows.
    """

    def length(left, right) -> int:
        places: dict[str, int] = {}
        for i, token in enumerate(left):
            places[token] = places.get(token, 0) | (1 << i)
        full = (1 << len(left)) - 1
        row = full
        for token in right:
            hit = row & places.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(left) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def rouge_l(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Add ``precision``, ``recall`` and ``rouge_l`` (their harmonic mean)."""
    cut = df.withColumns({"_p": rouge_tokens(F.col(prediction)), "_r": rouge_tokens(F.col(reference))})
    scored = cut.withColumn("_lcs", common_subsequence("_r", "_p").cast("double")).withColumns(
        {
            "precision": F.coalesce(F.try_divide("_lcs", F.size("_p").cast("double")), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide("_lcs", F.size("_r").cast("double")), F.lit(0.0)),
        }
    )
    both = F.col("precision") + F.col("recall")
    f = F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2, both), F.lit(0.0))
    return scored.withColumn("rouge_l", f).drop("_p", "_r", "_lcs")


# Fixed value: the mark before a final answer in the math corpus.
ANSWER_PATTERN = r"####\s*(-?[0-9.,]+)"


def final_answer(text: Column) -> Column:
    found = F.regexp_extract(text, ANSWER_PATTERN, 1)
    return F.replace(F.when(found != "", found), F.lit(","), F.lit(""))


def final_answer_match(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Add ``correct``: both name the same final answer; no answer is wrong."""
    same = final_answer(F.col(prediction)) == final_answer(F.col(reference))
    return df.withColumn("correct", F.coalesce(same, F.lit(False)))


def task_rollup(scores: DataFrame, score: str = "score") -> DataFrame:
    """Means per task and seed, per task, and over all."""
    return scores.rollup("task", "seed").agg(F.count("*").alias("items"), F.avg(score).alias("mean_score"))
