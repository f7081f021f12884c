"""Step logits of two sides to aligned steps, matched candidates and a loss."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.constants import (
    DEFAULT_TEMPERATURE,
    DEFAULT_THRESHOLD,
    DEFAULT_TOPK,
    MASKED_LOGIT_SORTED,
    SPECIAL_PAIRS_SORTED,
)
from tokenloom.operators import align as A
from tokenloom.operators import candidates as C
from tokenloom.operators import losses as L
from tokenloom.operators.labels import content_positions
from tokenloom.operators.lookup import lookup
from tokenloom.operators.vocab import exact_map, invert_last
from tokenloom.session import materialize, materialize_by

# Fixed value: spare ids behind the student's vocabulary in the inverse map.
SPARE_IDS = 256

# What an id outside its vocabulary reads as in an alignment.
UNKNOWN_TOKEN = "\ufffd"


@dataclass(frozen=True)
class Sides:
    """Both vocabularies, the static map and the sizes of the id spaces."""

    teacher: DataFrame
    student: DataFrame
    mapping: DataFrame
    inverse: DataFrame
    tea_size: int
    stu_size: int
    first_id: int = 1

    @staticmethod
    def of(teacher: DataFrame, student: DataFrame, tea_size: int, stu_size: int, first_id: int = 1) -> Sides:
        """Built on the exact map. The maps are as small as a vocabulary and used many
        times, so they are materialised."""
        mapping = materialize(exact_map(teacher, student))
        return Sides(teacher, student, mapping, materialize(invert_last(mapping)), tea_size, stu_size, first_id)


def side_tokens(sides: Sides) -> DataFrame:
    """Both vocabularies as ``(side, token_id, token)``."""
    return sides.teacher.select(
        F.lit("teacher").alias("side"), F.col("id").alias("token_id"), "token"
    ).unionByName(sides.student.select(F.lit("student").alias("side"), F.col("id").alias("token_id"), "token"))


def weighted_steps(steps: DataFrame, sides: Sides, engine: str = "sql") -> DataFrame:
    """``weight`` and ``token`` of the content steps ``(sample_id, side, pos, token_id, logits)``.

    An id outside its vocabulary, such as an added token, reads as ``UNKNOWN_TOKEN``.
    """
    slim = steps.select("sample_id", "side", "pos", "token_id", "logits")
    weights = A.entropy_weight(slim, ["sample_id", "side"], engine=engine)
    named = lookup(weights, side_tokens(sides), ["side", "token_id"], salt_by=["sample_id", "pos"])
    return named.withColumn("token", F.coalesce("token", F.lit(UNKNOWN_TOKEN)))


def sample_status(steps: DataFrame) -> DataFrame:
    """``(sample_id, status)`` of every sample that has a step on either side."""
    of = {side: F.count_if(F.col("side") == side) for side in ("student", "teacher")}
    return steps.groupBy("sample_id").agg(A.align_status(of["student"], of["teacher"]).alias("status"))


def with_status(steps: DataFrame, loss: DataFrame) -> DataFrame:
    """One row for every sample: a sample without content has a status and no loss."""
    return sample_status(steps).join(loss, "sample_id", "left")


def content_steps(rows: DataFrame, logits: DataFrame) -> DataFrame:
    """``(sample_id, side, pos, token_id, logits)`` of the labelled positions.

    ``rows`` are prepared rows ``(sample_id, side, ids, labels)``; ``logits`` is
    ``(sample_id, side, pos, logits)`` over whole sequences, ``pos`` from 0. Ids and vectors
    are filtered together; the wide rows move once, to their sample.
    """
    kept = content_positions(rows.select("sample_id", "side", "ids", "labels"))
    return logits.repartition("sample_id").join(kept.repartition("sample_id"), ["sample_id", "side", "pos"]).select(
        "sample_id", "side", "pos", "token_id", "logits"
    )


def aligned_samples(
    steps: DataFrame, sides: Sides, cost: str = "weighted", engine: str = "sql", strip: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The samples' token rows and their alignment."""
    samples = A.sample_tokens(weighted_steps(steps, sides, engine))
    return samples, A.align(samples, cost, strip=strip)


def step_candidates(merged: DataFrame, sides: Sides, k: int = DEFAULT_TOPK, engine: str = "sql") -> tuple[DataFrame, DataFrame]:
    """Decoded top-K of both sides of every aligned step.

    The wide vectors are read once for both sides. The candidates, K small rows per step
    and side, are materialised: both directions and both roles start from them.
    """
    both = F.array(
        F.struct(F.lit("teacher").alias("side"), F.col("tea_logits").alias("logits")),
        F.struct(F.lit("student").alias("side"), F.col("stu_logits").alias("logits")),
    )
    long = merged.select("sample_id", "step", F.inline(both))
    top = C.topk(long, k, id_base=sides.first_id, engine=engine)
    found = materialize(lookup(top, side_tokens(sides), ["side", "token_id"], salt_by=["sample_id", "step"]))

    def of(side: str) -> DataFrame:
        return found.filter(F.col("side") == side).drop("side")

    return of("teacher"), of("student")


def matched_pairs(
    merged: DataFrame,
    sides: Sides,
    k: int = DEFAULT_TOPK,
    threshold: float = DEFAULT_THRESHOLD,
    pool: str = "published",
    markers: str = "published",
    engine: str = "sql",
) -> DataFrame:
    """Pairs of both directions, read from the top-K of both sides."""
    teacher, student = step_candidates(merged, sides, k, engine)
    return C.match_both(
        teacher, student, sides.mapping, sides.inverse, sides.tea_size, sides.stu_size + SPARE_IDS,
        threshold, pool, markers, first_id=sides.first_id,
    )


def contextual_loss(
    steps: DataFrame,
    sides: Sides,
    k: int = DEFAULT_TOPK,
    threshold: float = DEFAULT_THRESHOLD,
    temperature: float = DEFAULT_TEMPERATURE,
    mode: str = "published",
    engine: str = "sql",
) -> DataFrame:
    """``(sample_id, status, distill_loss, unmasked_rate)`` of the main method.

    The merged vectors are needed twice, for the candidates and for the logits of the pairs
    found. They are written once, in buckets by sample, instead of merging twice.
    """
    _, aligned = aligned_samples(steps, sides, engine=engine)
    merged = materialize_by(
        A.merge_by_group(aligned, steps.select("sample_id", "side", "pos", "logits")), "sample_id"
    )
    pairs = materialize(matched_pairs(merged, sides, k, threshold, mode, mode, engine))
    gathered = C.gather_logits(pairs, merged, id_base=sides.first_id)
    loss = L.kl_topk(gathered, temperature, mode)
    return with_status(steps, loss.join(C.unmasked_rate(pairs), "sample_id"))


def batch_rate(losses: DataFrame, batches: DataFrame) -> DataFrame:
    """``(batch, unmasked_rate)``: the mean rate over the aligned samples of a batch."""
    return losses.join(batches, "sample_id").groupBy("batch").agg(F.avg("unmasked_rate").alias("unmasked_rate"))


def first_wins_loss(
    steps: DataFrame,
    batches: DataFrame,
    sides: Sides,
    k: int = DEFAULT_TOPK,
    threshold: float = DEFAULT_THRESHOLD,
    temperature: float = DEFAULT_TEMPERATURE,
    engine: str = "sql",
) -> DataFrame:
    """``(sample_id, status, distill_loss)`` of the one-direction method over the whole vocabulary.

    ``batches`` is ``(sample_id, batch)``, the order of the run. The first proposal for a
    teacher id stays for the rest of the run, so a sample sees the entries made up to it.
    """
    _, aligned = aligned_samples(steps, sides, engine=engine, strip="spaces")
    merged = materialize_by(
        A.merge_by_group(aligned, steps.select("sample_id", "side", "pos", "logits")), "sample_id"
    )
    teacher, student = step_candidates(merged, sides, k, engine)
    pool = C.candidate_pool(student, sides.mapping, sides.tea_size, "published", sides.first_id)
    proposals = C.nearest_candidate(
        C.unmapped_candidates(teacher, sides.mapping), pool, threshold, strip="spaces"
    )
    learnt = C.dynamic_map_first(proposals.join(batches, "sample_id"))
    remapped = C.full_vocab_remap(
        merged.join(batches, "sample_id"), sides.mapping, id_base=sides.first_id, learnt=learnt, engine=engine
    )
    loss = L.kl_dense(remapped, temperature, engine)
    return with_status(steps, loss)


def per_step_loss(
    steps: DataFrame,
    sides: Sides,
    k: int = DEFAULT_TOPK,
    threshold: float = DEFAULT_THRESHOLD,
    enable_topk: bool = True,
    engine: str = "sql",
) -> DataFrame:
    """``(sample_id, status, distill_loss, unmasked_rate)`` with plain alignment and matches that do not carry over."""
    _, aligned = aligned_samples(steps, sides, cost="norm", engine=engine)
    merged = materialize_by(
        A.merge_by_group(aligned, steps.select("sample_id", "side", "pos", "logits")), "sample_id"
    )
    teacher, student = step_candidates(merged, sides, k, engine)
    pairs = C.match_per_step(
        teacher, student, sides.mapping, enable_topk, threshold, strip="marker", pairs=SPECIAL_PAIRS_SORTED
    ).withColumn("direction", F.lit("t2s"))
    pairs = materialize(pairs)
    gathered = C.gather_logits(pairs, merged, MASKED_LOGIT_SORTED, sides.first_id)
    vectors = gathered.select(
        "sample_id", F.col("pairs.tea_logit").alias("tea_logits"), F.col("pairs.stu_logit").alias("stu_logits")
    )
    rate = C.unmasked_rate(pairs)
    return with_status(steps, L.kl_dense(vectors, temperature=1.0).join(rate, "sample_id"))
