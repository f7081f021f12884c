"""Streams over files: prepared samples, windowed means, exact running means, shuffled samples.

Jobs with a state of their own (running means, shuffles) use ``transformWithStateInPandas``. Their
keys are blocks or lanes, not whole runs or corpora, so what one key holds is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tokenloom.constants import DEFAULT_SEED
from tokenloom.operators.scoring import BLOCK_STEPS, LOSSES, METRICS, guarded

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CLOSING = -1  # the step of a row that only moves the watermark


def prepare_stream(
    records: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Prepare every micro-batch as the table it is, so that a vocabulary of any size will do.

    The result is written as parquet, each batch to its own folder, which a repeat overwrites.
    """

    def save(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        records.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def windowed_means(
    metrics: DataFrame, window: str = "1 hour", late: str = "10 minutes", digits: int | None = None
) -> DataFrame:
    """Means per run and event-time window; rows that are not finite count but add nothing.

    The same expression serves batch tables and streams. Sums are kept per window, so a
    run is spread over its windows.
    """
    source = metrics.withWatermark("ts", late) if metrics.isStreaming else metrics
    return (
        source.groupBy("run", F.window("ts", window).alias("_w"))
        .agg(F.count("*").alias("rows"), *[F.sum(e).alias(f"_{n}") for n, e in guarded(LOSSES, digits=digits).items()])
        .select(
            "run",
            F.col("_w.start").alias("window_start"),
            "rows",
            *[(F.col(f"_{n}").cast("double") / F.col("rows")).alias(n) for n in LOSSES],
        )
    )


def windowed_means_stream(
    metrics: DataFrame, out: str, checkpoint: str, window: str = "1 hour", late: str = "10 minutes", digits: int | None = None
) -> StreamingQuery:
    """Write changed windows per micro-batch; a repeated batch overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        windowed_means(metrics, window, late, digits)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def latest_windows(stored: DataFrame) -> DataFrame:
    """The last state written of every window."""
    rest = [c for c in stored.columns if c not in ("run", "window_start", "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("_last")
    return stored.groupBy("run", "window_start").agg(last).select("run", "window_start", "_last.*")


def _started(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a job with state to parquet files."""
    conf = rows.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start(out)
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


class _Accumulate(StatefulProcessor):
    """Running sums of one block of a run, in order of step; rows wait for the watermark."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        fields = ", ".join(f"{n} long" for n in self.names)
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"step long, ts long, {fields}")
        self.sums = handle.getValueState("sums", f"n long, {fields}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = pd.concat(rows, ignore_index=True)
        given = given[given["step"] != CLOSING]
        if not len(given):
            return
        given = given.assign(ts=given["ts"].astype("datetime64[us]").astype("int64"))[["step", "ts", *self.names]]
        held = pd.DataFrame(self.waiting.get(), columns=given.columns)
        self.handle.registerTimer(int(given["ts"].max()) // 1000 + 1)
        yield from self._release(key, pd.concat((held, given)) if len(held) else given, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.DataFrame(self.waiting.get(), columns=["step", "ts", *self.names])
        yield from self._release(key, held, timerValues)

    def _release(self, key, rows: pd.DataFrame, timers) -> Iterator[pd.DataFrame]:
        due = rows["ts"] // 1000 < timers.getCurrentWatermarkInMs()
        kept = rows[~due]
        if len(kept):
            self.waiting.put([tuple(map(int, r)) for r in kept.itertuples(index=False)])
        else:
            self.waiting.clear()
        out = rows[due].sort_values("step", kind="stable")
        if len(out):
            before = self.sums.get() or (0,) * (1 + len(self.names))
            sums = out[self.names].cumsum() + np.array(before[1:], np.int64)
            n = before[0] + np.arange(1, len(out) + 1)
            self.sums.update((int(n[-1]), *map(int, sums.iloc[-1])))
            yield pd.DataFrame({"run": key[0], "block": key[1], "step": out["step"].to_numpy(), "n": n, **{c: sums[c].to_numpy() for c in self.names}})


def running_mean_stream(
    metrics: DataFrame, out: str, checkpoint: str, values: tuple[str, ...] = METRICS, late: str = "1 hour",
    block: int = BLOCK_STEPS, digits: int = 4,
) -> StreamingQuery:
    """Exact running sums of a stream whose rows come in any order within ``late`` of event time.

    Rows ``(run, step, ts, <values>)``, ``ts`` growing with ``step``, are held in the state of
    their run's block of steps until the watermark has passed them, then added up by step.
    A run is spread over its blocks; ``running_means`` puts them together. Values count with
    ``digits`` decimal digits, so sums are whole numbers. The rows of the last ``late`` come out
    in the batch after the one whose rows move the watermark beyond them; two closing rows
    with a null step, in batches of their own, drain the stream.
    """
    scale = 10**digits
    names = [f"u_{v}" for v in values]
    added = {f"u_{v}": (c * scale).cast("long") for v, c in guarded(values, digits=digits).items()}
    # Closing rows go as far as the state: filtered before, they would not move the watermark.
    step = F.coalesce("step", F.lit(CLOSING))
    rows = metrics.withWatermark("ts", late).select(
        "run", F.floor(step / block).alias("block"), step.alias("step"), "ts", *[c.alias(n) for n, c in added.items()]
    )
    fields = ", ".join(f"{n} long" for n in names)
    summed = rows.groupBy("run", "block").transformWithStateInPandas(
        _Accumulate(names), f"run string, block long, step long, n long, {fields}", "Append", "EventTime"
    )
    return _started(summed, out, checkpoint)


def running_means(stored: DataFrame, values: tuple[str, ...] = METRICS, digits: int = 4) -> DataFrame:
    """``(run, step, <values>)``: cumulative means from what ``running_mean_stream`` has written."""
    names = ["n", *(f"u_{v}" for v in values)]
    last = stored.groupBy("run", "block").agg(*[F.max_by(c, "n").alias(c) for c in names])
    earlier = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("run", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in names])
    total = {c: F.col(c) + F.col(f"_{c}") for c in names}
    means = [(total[f"u_{v}"].cast("double") / F.lit(float(10**digits)) / total["n"]).alias(v) for v in values]
    return stored.join(before, ["run", "block"]).select("run", "step", *means)


class _Pick(StatefulProcessor):
    """A buffer of rows; each further row drives a seeded one out."""

    def __init__(self, buffer: int, seed: int, columns: list[str], kinds: str):
        self.buffer, self.seed, self.columns, self.kinds = buffer, seed, columns, kinds

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.kinds)
        self.place = handle.getValueState("place", "given long, taken long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lane = int(key[0])
        held = [tuple(r) for r in self.rows.get()]
        given, taken = self.place.get() or (0, 0)
        frame = pd.concat(rows, ignore_index=True)
        out, closing = [], bool(frame["is_closing"].any())

        def emit(at: int, row: tuple) -> None:
            out.append((lane, taken + len(out), *row))

        for row in frame[~frame["is_closing"]].sort_values("arrival_order", kind="stable")[self.columns].itertuples(index=False, name=None):
            given += 1
            if len(held) < self.buffer:
                held.append(row)
                continue
            at = int(np.random.Generator(np.random.PCG64([self.seed, lane, given])).integers(len(held)))
            emit(at, held[at])
            held[at] = row
        if closing:
            order = np.random.Generator(np.random.PCG64([self.seed, lane, 0, given])).permutation(len(held))
            for at in order:
                emit(int(at), held[at])
            held = []
        if held:
            self.rows.put(held)
        else:
            self.rows.clear()
        self.place.update((given, taken + len(out)))
        if out:
            yield pd.DataFrame(out, columns=["lane", "place", *self.columns])


def buffer_shuffle_stream(
    rows: DataFrame, key: str, buffer: int, out: str, checkpoint: str, lanes: int = 1, seed: int = DEFAULT_SEED
) -> StreamingQuery:
    """Shuffle a stream through buffers: ``(lane, place, <columns>)``, ``place`` from 0 in each lane.

    Rows are dealt over ``lanes`` by a hash of ``key`` and keep their order of arrival there: by
    batch, then by ``key``. A lane holds ``buffer // lanes`` rows; each further row drives out
    one that is drawn by seed, lane and count, so the same batches give the same order. A row
    comes at most that many places earlier than it arrived, and later by chance. A row
    with a null key closes the stream: it drains all lanes and is not put out.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    closing = F.col(key).isNull()
    lane = F.when(closing, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(F.array(F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")))
    # Names with a leading underscore would not reach pandas.
    dealt = rows.select("*", F.explode(lane).alias("deal_lane"), F.col(key).alias("arrival_order"), closing.alias("is_closing"))
    shuffled = dealt.groupBy("deal_lane").transformWithStateInPandas(
        _Pick(max(1, buffer // lanes), seed, rows.columns, kinds), f"lane int, place long, {kinds}", "Append", "None"
    )
    return _started(shuffled, out, checkpoint)
