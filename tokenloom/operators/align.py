"""Alignment of two tokenizations of a text, and merging of step vectors along it.

A sample is one row with both token arrays, so alignment needs no shuffle. Its recurrence is
sequential and runs in Python on Arrow batches (``functions.warping``), many samples at a
time; a task keeps the distances between tokens that it has met. Where samples differ much
in size, ``deal`` spreads them so that all partitions have about as many cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.constants import (
    DEFAULT_STUDENT_MARKER,
    DEFAULT_TEACHER_MARKER,
    SPECIAL_PAIRS,
    SPECIAL_PAIRS_SORTED,
)
from tokenloom.functions import arrays, wide
from tokenloom.functions.warping import Sample, TokenCosts, dtw_path, warp_all  # noqa: F401
from tokenloom.operators.ordering import global_index
from tokenloom.session import materialize

TABLE_CELLS = 1 << 24  # cells of the samples that a task solves at a time; their costs are between distinct tokens only


def align_status(student_steps: Column, teacher_steps: Column) -> Column:
    """From the numbers of content steps: samples without any are marked, not dropped."""
    return (
        F.when(F.coalesce(student_steps, F.lit(0)) < 1, "empty_student")
        .when(F.coalesce(teacher_steps, F.lit(0)) < 1, "empty_teacher")
        .otherwise("ok")
    )


def entropy_weight(steps: DataFrame, keys: list[str], logits: str = "logits", engine: str = "sql") -> DataFrame:
    """Replace the vector by ``entropy`` and ``weight`` in 3 .. 5.

    Vectors are reduced where they lie, so only numbers move to their sample. A sample with
    equal entropies gets weight 3.
    """
    entropy = (wide if engine == "arrow" else arrays).entropy(F.col(logits))
    rest = [c for c in steps.columns if c != logits]
    return weight_of_entropy(steps.select(*rest, entropy.alias("entropy")).repartition(keys[0]), keys)


def weight_of_entropy(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``weight`` from ``entropy``; the window is one side of one sample."""
    group = Window.partitionBy(*keys)
    low, high = F.min("entropy").over(group), F.max("entropy").over(group)
    x = F.try_divide(F.col("entropy") - low, high - low)
    sigmoid = F.lit(1.0) / (F.lit(1.0) + F.exp(-(x * 4 - 2)))
    return steps.withColumn("weight", F.coalesce(F.floor(sigmoid * 3 + 3), F.lit(3)).cast("int"))


def sample_tokens(steps: DataFrame) -> DataFrame:
    """One row per sample from rows ``(sample_id, side, pos, token, weight)``.

    ``pos`` is any increasing number, such as a place in the padded sequence; the arrays
    ``tea_pos`` and ``stu_pos`` say which one each content step has.
    """

    def of(side: str, field: str) -> Column:
        mine = F.filter("_steps", lambda e: e["side"] == side)
        return F.transform(mine, lambda e: e[field])

    listed = steps.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("side", "pos", "token", "weight"))).alias("_steps")
    )
    return listed.select(
        "sample_id",
        of("teacher", "token").alias("tea_tokens"),
        of("student", "token").alias("stu_tokens"),
        of("teacher", "weight").alias("tea_weights"),
        of("student", "weight").alias("stu_weights"),
        of("teacher", "pos").cast("array<long>").alias("tea_pos"),
        of("student", "pos").cast("array<long>").alias("stu_pos"),
    )


def _spans(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """First and last partner of every position; partners on a path are consecutive."""
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    last = np.r_[first[1:], len(own)] - 1
    return np.stack((other[first], other[last]), axis=1)


def _list_of_pairs(parts: list[np.ndarray], names: tuple[str, str]) -> pa.Array:
    joined = np.concatenate(parts) if parts else np.zeros((0, 2), dtype=np.int32)
    offsets = np.cumsum([0] + [len(p) for p in parts])
    fields = [pa.field(name, pa.int32()) for name in names]
    columns = [pa.array(joined[:, c], pa.int32()) for c in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))


_ALIGNED = (
    "status string, total_cost double, path array<struct<i:int,j:int>>, "
    "tea_spans array<struct<lo:int,hi:int>>, stu_spans array<struct<lo:int,hi:int>>, "
    "tea_pos array<long>, stu_pos array<long>"
)


def _align_batches(costs: Callable[[], TokenCosts]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["sample_id", "status", "total_cost", "path", "tea_spans", "stu_spans", "tea_pos", "stu_pos"]
    path, span = (pa.list_(pa.struct([pa.field(name, pa.int32()) for name in pair])) for pair in (("i", "j"), ("lo", "hi")))
    kinds = [pa.float64(), path, span, span]

    def solved(batch: pa.RecordBatch, samples: list[Sample]) -> pa.RecordBatch:
        found = warp_all(samples)
        totals, paths = [t for t, _ in found], [p for _, p in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("sample_id"),
                pa.repeat("ok", batch.num_rows),
                pa.array(totals, pa.float64()),
                _list_of_pairs(paths, ("i", "j")),
                _list_of_pairs([_spans(p[:, 0], p[:, 1]) for p in paths], ("lo", "hi")),
                _list_of_pairs([_spans(p[:, 1], p[:, 0]) for p in paths], ("lo", "hi")),
                batch.column("tea_pos"),
                batch.column("stu_pos"),
            ],
            names=names,
        )

    def without_path(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = [pa.nulls(batch.num_rows, kind) for kind in kinds]
        given = [batch.column(name) for name in ("sample_id", "status", "tea_pos", "stu_pos")]
        return pa.RecordBatch.from_arrays([*given[:2], *none, *given[2:]], names=names)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = costs()
        for whole in batches:
            batch = whole
            if "status" in whole.schema.names:
                ok = pc.equal(whole.column("status"), "ok")
                batch = whole.filter(ok)
                if batch.num_rows < whole.num_rows:
                    yield without_path(whole.filter(pc.invert(ok)))
            tokens = [batch.column(f"{side}_tokens") for side in ("tea", "stu")]
            weights = [batch.column(f"{side}_weights") for side in ("tea", "stu")]
            cells = np.cumsum(np.prod([pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.float64) for t in tokens], axis=0))
            # A batch may hold thousands of long samples: it is solved part by part.
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + TABLE_CELLS, side="right")))
                part = batch.slice(at, stop - at)
                tables = known.tables(list(zip(*(t.slice(at, stop - at).to_pylist() for t in tokens))))
                samples = []
                for row, (table, rows, cols, values) in enumerate(tables, at):
                    given = [w[row] for w in weights]
                    both = all(w.is_valid for w in given)
                    samples.append(Sample(table, rows, cols, *((w.values.to_numpy() for w in given) if both else (None, None)), values))
                yield solved(part, samples)
                at = stop

    return aligned


def sample_cells(samples: DataFrame) -> DataFrame:
    """``(sample_id, cells)``: how large the table of every sample is."""
    return samples.select("sample_id", (F.size("tea_tokens").cast("long") * F.size("stu_tokens")).alias("cells"))


def deal(samples: DataFrame, parts: int | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Spread samples over ``parts`` partitions of about as many cells each.

    Samples are numbered by falling number of cells and dealt out to and fro, so a round gives
    every partition one sample of about the same size, and two partitions differ by no more
    than the largest sample. Only ids and sizes are sorted. ``sample_id`` has to be unique.
    With ``cells``, from ``sample_cells``, the rows may be what the samples are made of: texts
    are moved for a fraction of the bytes of their tokens.
    """
    parts = parts or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sizes are read several times to be sorted, and are made of all tokens.
    sizes = materialize((sample_cells(samples) if cells is None else cells).withColumnRenamed("cells", "_cells"))
    ranks = global_index(sizes, [F.desc("_cells"), "sample_id"], "_rank")
    turn = F.pmod("_rank", F.lit(2 * parts))
    bins = F.when(turn < parts, turn).otherwise(2 * parts - 1 - turn).cast("int")
    placed = samples.join(ranks.select("sample_id", bins.alias("_bin")), "sample_id")
    return placed.repartitionById(parts, F.col("_bin")).drop("_bin")


def align(
    samples: DataFrame,
    cost: str = "weighted",
    marker_t: str = DEFAULT_TEACHER_MARKER,
    marker_s: str = DEFAULT_STUDENT_MARKER,
    strip: str | None = None,
    pairs: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(sample_id, status, total_cost, path, tea_spans, stu_spans, tea_pos, stu_pos)``.

    ``path`` is an array of (i teacher, j student), which count content steps from 0. A
    span is the first and last partner of a step: of teacher steps in ``tea_spans``, of
    student ones in ``stu_spans``. ``tea_pos`` and ``stu_pos`` are the steps' own numbers,
    0, 1, .. where ``samples`` has none. Samples without content have a status and no path.

    ``weighted``: edit distance times both step weights. ``norm``: edit distance over the
    summed lengths, no weights, with that method's own special pairs and marker rule.
    The memory of a sample grows with its lengths, not with its cells.
    """
    if cost not in ("weighted", "norm"):
        raise ValueError(f"unknown cost {cost!r}")
    norm = cost == "norm"
    strip = strip or ("marker" if norm else "both")
    pairs = pairs or (SPECIAL_PAIRS_SORTED if norm else SPECIAL_PAIRS)
    for side in ("tea", "stu"):
        if f"{side}_pos" not in samples.columns:
            own = F.transform(f"{side}_tokens", lambda t, i: i.cast("long"))
            samples = samples.withColumn(f"{side}_pos", own)
    marked = samples.withColumn("status", align_status(F.size("stu_tokens"), F.size("tea_tokens")))

    none = F.lit(None).cast("array<int>")
    ready = marked.select(
        "sample_id",
        "status",
        "tea_tokens",
        "stu_tokens",
        (none if norm else F.col("tea_weights")).alias("tea_weights"),
        (none if norm else F.col("stu_weights")).alias("stu_weights"),
        "tea_pos",
        "stu_pos",
    )
    kind = samples.schema["sample_id"].dataType.simpleString()

    def costs() -> TokenCosts:
        return TokenCosts(norm, marker_t, marker_s, strip, dict(pairs))

    # Samples without content go through the same step, so that what makes them runs once.
    return ready.mapInArrow(_align_batches(costs), f"sample_id {kind}, {_ALIGNED}")


def path_table(aligned: DataFrame) -> DataFrame:
    """``(sample_id, ord, i, j)``."""
    steps = aligned.select("sample_id", F.posexplode("path").alias("ord", "step"))
    return steps.select("sample_id", "ord", F.col("step.i").alias("i"), F.col("step.j").alias("j"))


def match_lists(aligned: DataFrame, by: str = "i") -> DataFrame:
    """The ascending partners of every teacher (``i``) or student (``j``) position."""
    spans = "tea_spans" if by == "i" else "stu_spans"
    return aligned.select("sample_id", F.posexplode(spans).alias(by, "_span")).select(
        "sample_id", by, F.sequence("_span.lo", "_span.hi").alias("members")
    )


def _groups(spans: Column) -> Column:
    """Ordered without repeats. A list can only repeat for neighbours on the path."""
    return F.filter(spans, lambda s, k: (k == 0) | (s != F.get(spans, k - 1)))


def distinct_groups(aligned: DataFrame) -> DataFrame:
    """``(sample_id, step, members)``: the different partner lists of the teacher
    positions. Lists may overlap, so they are not a partition of the student positions."""
    return aligned.select(
        "sample_id", F.posexplode(_groups(F.col("tea_spans"))).alias("step", "_span")
    ).select("sample_id", "step", F.sequence("_span.lo", "_span.hi").alias("members"))


def mean_vectors(rows: DataFrame, keys: list[str], logits: str = "logits", weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean of array columns per group, combined before the shuffle."""
    vector = array_to_vector(arrays.doubles(F.col(logits)))
    mean = Summarizer.mean(vector, F.col(weight)) if weight else Summarizer.mean(vector)
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias(logits))


def merge_by_student(aligned: DataFrame, teacher: DataFrame) -> DataFrame:
    """One teacher vector per student position: the mean over its partners.

    ``teacher`` is ``(sample_id, pos, logits)``; returns ``(sample_id, j, logits)``.
    """
    steps = aligned.select("sample_id", "tea_pos", F.explode("path").alias("step"))
    path = steps.select("sample_id", F.get("tea_pos", F.col("step.i")).alias("pos"), F.col("step.j").alias("j"))
    placed = teacher.repartition("sample_id").join(path, ["sample_id", "pos"])
    return mean_vectors(placed, ["sample_id", "j"])


def _size(span: Column) -> Column:
    return (span["hi"] - span["lo"] + 1).cast("double")


def _group_weights(aligned: DataFrame) -> DataFrame:
    """``(sample_id, side, pos, step, weight)``: the part each position has in a step.

    A step averages student positions j; for the teacher, each j stands for the average of
    its partners i. So i has weight 1 / (|partners of j| * |group|) for every such j.
    """

    def teacher(group: Column, step: Column) -> Column:
        def through(j: Column) -> Column:
            return arrays.let(
                F.get("stu_spans", j),
                lambda span: F.transform(
                    F.sequence(span["lo"], span["hi"]),
                    lambda i: entry("teacher", i, step, F.lit(1.0) / (_size(span) * _size(group))),
                ),
            )

        return F.flatten(F.transform(F.sequence(group["lo"], group["hi"]), through))

    def student(group: Column, step: Column) -> Column:
        return F.transform(
            F.sequence(group["lo"], group["hi"]),
            lambda j: entry("student", j, step, F.lit(1.0) / _size(group)),
        )

    def entry(side: str, pos: Column, step: Column, weight: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.get("tea_pos" if side == "teacher" else "stu_pos", pos).alias("pos"),
            step.alias("step"),
            weight.alias("weight"),
        )

    groups = aligned.filter(F.col("path").isNotNull()).select(
        "sample_id", "stu_spans", "tea_pos", "stu_pos", _groups(F.col("tea_spans")).alias("_groups")
    )
    shares = F.flatten(
        F.transform("_groups", lambda g, step: F.concat(teacher(g, step), student(g, step)))
    )
    return groups.select("sample_id", F.inline(shares))


def merge_by_group(aligned: DataFrame, steps: DataFrame) -> DataFrame:
    """``(sample_id, step, tea_logits, stu_logits)``: both sides averaged over each step.

    ``steps`` is ``(sample_id, side, pos, logits)`` with the ``pos`` that the samples were
    listed with. The nested means are one weighted mean, so the wide rows move once, by
    ``sample_id``, and all that follows reuses that partitioning.
    """
    placed = steps.repartition("sample_id").join(_group_weights(aligned), ["sample_id", "side", "pos"])
    means = mean_vectors(placed, ["sample_id", "step", "side"], weight="weight")

    def of(side: str) -> Column:
        return F.first(F.when(F.col("side") == side, F.col("logits")), ignorenulls=True)

    return means.groupBy("sample_id", "step").agg(
        of("teacher").alias("tea_logits"), of("student").alias("stu_logits")
    )


def merged_token_text(samples: DataFrame, aligned: DataFrame) -> DataFrame:
    """The teacher tokens joined together per student position."""
    joined = samples.join(aligned.filter(F.col("status") == "ok"), "sample_id")
    texts = F.transform(
        "stu_spans", lambda s: F.array_join(F.slice("tea_tokens", s["lo"] + 1, s["hi"] - s["lo"] + 1), "")
    )
    return joined.select("sample_id", F.posexplode(texts).alias("j", "text"))
