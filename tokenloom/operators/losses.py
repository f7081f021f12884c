"""Divergences between two logit vectors of a row, and their reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.constants import DEFAULT_ALPHA, DEFAULT_TEMPERATURE, IGNORE_INDEX
from tokenloom.functions import arrays, wide

ENGINES = ("sql", "arrow")


def _engine(engine: str):
    """Expressions in the JVM, or the numpy forms for wide vectors."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}")
    return wide if engine == "arrow" else None



def truncate_teacher_vocab(teacher: Column, student: Column) -> Column:
    return F.slice(teacher, F.lit(1), F.size(student))


def _divergence_terms(p_logits: Column, q_logits: Column, factor: float) -> Column:
    """p * (factor * ln p - ln q) per entry, p and q the two softmaxes."""
    return F.transform(
        F.arrays_zip(
            arrays.log_softmax(p_logits).alias("p"),
            arrays.log_softmax(q_logits).alias("q"),
        ),
        lambda e: F.exp(e["p"]) * (e["p"] * F.lit(float(factor)) - e["q"]),
    )


def kl_topk_step(teacher: Column, student: Column, temperature: float) -> Column:
    """``struct<total, finite>`` of one step.

    Only the student is divided by the temperature; the teacher's log-probabilities are
    multiplied by its square. Infinite terms count neither in the sum nor in ``finite``.
    """
    terms = _divergence_terms(teacher, arrays.scaled(student, temperature), temperature**2)
    return arrays.let(
        F.filter(terms, lambda x: F.abs(x) != F.lit(float("inf"))),
        lambda kept: F.struct(arrays.total(kept).alias("total"), F.size(kept).cast("long").alias("finite")),
    )


def pair_vectors(pairs: Column, halves: str = "published") -> tuple[Column, Column]:
    """Teacher and student vectors of a step's pair array.

    ``published`` swaps the sides of the student-to-teacher half, as the published method
    does; ``clean`` keeps every logit on its own side.
    """
    if halves not in ("published", "clean"):
        raise ValueError(f"unknown halves {halves!r}")

    def vector(own: str, other: str) -> Column:
        if halves == "clean":
            return F.transform(pairs, lambda e: e[own])
        return F.transform(pairs, lambda e: F.when(e["direction"] == "s2t", e[other]).otherwise(e[own]))

    return vector("tea_logit", "stu_logit"), vector("stu_logit", "tea_logit")


def kl_topk(steps: DataFrame, temperature: float = DEFAULT_TEMPERATURE, halves: str = "published") -> DataFrame:
    """Loss per sample of ``gather_logits`` rows: the sum over the number of finite terms."""
    teacher, student = pair_vectors(F.col("pairs"), halves)
    scored = steps.select("sample_id", kl_topk_step(teacher, student, temperature).alias("_kl"))
    return scored.groupBy("sample_id").agg(
        F.try_divide(F.sum("_kl.total"), F.sum("_kl.finite")).alias("distill_loss")
    )


def kl_dense(steps: DataFrame, temperature: float = DEFAULT_TEMPERATURE, engine: str = "sql") -> DataFrame:
    """The same loss over whole vectors ``tea_logits, stu_logits``."""
    reduce = wide.kl_topk_step if _engine(engine) else kl_topk_step
    step = reduce(F.col("tea_logits"), F.col("stu_logits"), temperature)
    scored = steps.select("sample_id", step.alias("_kl"))
    return scored.groupBy("sample_id").agg(
        F.try_divide(F.sum("_kl.total"), F.sum("_kl.finite")).alias("distill_loss")
    )


def forward_kl_step(teacher: Column, student: Column, temperature: float) -> Column:
    """T^2 * KL(teacher || student), both at temperature T."""
    terms = _divergence_terms(arrays.scaled(teacher, temperature), arrays.scaled(student, temperature), 1.0)
    return arrays.total(terms) * F.lit(float(temperature) ** 2)


def reverse_kl_step(teacher: Column, student: Column, temperature: float) -> Column:
    return forward_kl_step(student, teacher, temperature)


def reduce_steps(steps: DataFrame, loss: Column, token_mean: bool = True) -> DataFrame:
    """One row: masked step losses over the mask sum, or over the number of samples."""
    scored = steps.select("sample_id", F.col("mask").cast("double").alias("mask"), loss.alias("_loss"))
    kept = F.sum(F.col("_loss") * F.col("mask"))
    if token_mean:
        return scored.agg(F.try_divide(kept, F.sum("mask")).alias("distill_loss"))
    per_sample = scored.groupBy("sample_id").agg(kept.alias("_kept"))
    return per_sample.agg(F.try_divide(F.sum("_kept"), F.count("*")).alias("distill_loss"))


def kl_forward(
    steps: DataFrame, temperature: float = DEFAULT_TEMPERATURE, token_mean: bool = True, engine: str = "sql"
) -> DataFrame:
    """``steps`` is ``(sample_id, mask, tea_logits, stu_logits)``; the wider teacher is cut."""
    teacher = truncate_teacher_vocab(F.col("tea_logits"), F.col("stu_logits"))
    step = wide.forward_kl_step if _engine(engine) else forward_kl_step
    return reduce_steps(steps, step(teacher, F.col("stu_logits"), temperature), token_mean)


def kl_reverse(
    steps: DataFrame, temperature: float = DEFAULT_TEMPERATURE, token_mean: bool = True, engine: str = "sql"
) -> DataFrame:
    teacher = truncate_teacher_vocab(F.col("tea_logits"), F.col("stu_logits"))
    step = wide.forward_kl_step if _engine(engine) else forward_kl_step
    return reduce_steps(steps, step(F.col("stu_logits"), teacher, temperature), token_mean)


def kl_generic(steps: DataFrame, reduction: str = "mean") -> DataFrame:
    """Plain KL; entries whose student logit is infinite are left out."""
    terms = arrays.let(
        F.arrays_zip(
            _divergence_terms(F.col("tea_logits"), F.col("stu_logits"), 1.0).alias("term"),
            arrays.doubles(F.col("stu_logits")).alias("logit"),
        ),
        lambda all_: F.transform(
            F.filter(all_, lambda e: F.abs(e["logit"]) != F.lit(float("inf"))), lambda e: e["term"]
        ),
    )
    scored = steps.select("sample_id", terms.alias("_terms")).select(
        arrays.total(F.col("_terms")).alias("_total"), F.size("_terms").alias("_finite")
    )
    loss = F.sum("_total")
    if reduction != "sum":
        loss = F.try_divide(loss, F.sum("_finite"))
    return scored.agg(loss.alias("distill_loss"))


def sorted_distance(teacher: Column, student: Column) -> Column:
    """L1 distance of the two probability vectors, each sorted; the narrower gets zeros."""
    def ordered(logits: Column) -> Column:
        return F.sort_array(arrays.softmax(logits), asc=False)

    gaps = F.zip_with(
        ordered(teacher), ordered(student),
        lambda p, q: F.abs(F.coalesce(p, F.lit(0.0)) - F.coalesce(q, F.lit(0.0))),
    )
    return arrays.total(gaps)


def sorted_probability_loss(
    teacher: DataFrame, student: DataFrame, engine: str = "sql", batches: DataFrame | None = None
) -> DataFrame:
    """Per sample: mean sorted distance over positions that carry a label on both sides.

    With ``batches`` ``(sample_id, batch)`` the positions of a batch are pooled: one row per
    batch, in which a long sample weighs more than a short one.

    Both inputs are ``(sample_id, rpos, label, logits)`` with ``rpos`` rotated so that the
    response starts at 0; positions are paired by an equi join.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("label") != IGNORE_INDEX).select(
            "sample_id", "rpos", F.col("logits").alias(name)
        )

    distance = wide.sorted_distance if _engine(engine) else sorted_distance
    paired = side(teacher, "tea_logits").join(side(student, "stu_logits"), ["sample_id", "rpos"])
    if batches is not None:
        paired = paired.join(batches, "sample_id")
    return paired.groupBy("sample_id" if batches is None else "batch").agg(
        F.avg(distance(F.col("tea_logits"), F.col("stu_logits"))).alias("distill_loss")
    )


def token_nll(logits: Column, target: Column, id_base: int = 0) -> Column:
    """-ln p of the target id, without building the whole distribution."""
    return arrays.let(
        arrays.doubles(logits),
        lambda v: arrays.let(
            F.array_max(v),
            lambda top: top
            + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
            - arrays.gather(v, target, id_base),
        ),
    )


def cross_entropy(
    steps: DataFrame, logits: str = "logits", target: str = "label", id_base: int = 0, engine: str = "sql"
) -> DataFrame:
    scored = steps.filter(F.col(target) != IGNORE_INDEX)
    nll = (wide.token_nll if _engine(engine) else token_nll)(F.col(logits), F.col(target), id_base)
    return scored.groupBy("sample_id").agg(F.avg(nll).alias("sft_loss"))


def blend(sft_loss: Column, distill_loss: Column, alpha: float = DEFAULT_ALPHA) -> Column:
    return sft_loss * F.lit(alpha) + distill_loss * F.lit(1.0 - alpha)


def nan_audit(losses: DataFrame, loss: str = "distill_loss") -> DataFrame:
    """Rows whose loss is not a number, for a quarantine table."""
    return losses.filter(F.isnan(loss))
