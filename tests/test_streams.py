"""Streams with a state of their own: running means out of order, and shuffles through buffers."""

import datetime
import random

import pytest

from tokenloom.operators import scoring
from tokenloom.streaming import jobs

METRICS = "run string, step long, ts timestamp, sft_loss double, distill_loss double, unmasked_rate double"
START = datetime.datetime(2024, 1, 1)


def files(spark, path, parts, schema):
    """A stream that reads one of the given lists of rows after the other."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_running_means_of_shuffled_rows_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        ("a" if rng.random() < 0.7 else "b", i, START + datetime.timedelta(seconds=i), float("nan") if i % 13 == 0 else round(rng.random(), 3), rng.randint(0, 99) / 4, None if i % 17 == 0 else 0.1)
        for i in range(240)
    ]
    late = sorted(rows, key=lambda r: r[1] + rng.randint(0, 50))  # none is more than 50 seconds late
    closing = [[(None, None, START + datetime.timedelta(days=d), None, None, None)] for d in (1, 2)]
    parts = [late[i : i + 60] for i in range(0, 240, 60)]
    stream = files(spark, f"{tmp_path}/in", [*parts, *closing], METRICS)
    jobs.running_mean_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", late="50 seconds", block=64).awaitTermination()
    found = sorted(map(tuple, jobs.running_means(spark.read.parquet(f"{tmp_path}/out")).collect()))
    batch = scoring.running_mean(spark.createDataFrame(rows, METRICS), block=32, digits=4)
    assert found == sorted(map(tuple, batch.collect())) and len(found) == 240


def test_exact_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(2)
    rows = [("a", i, START, rng.randint(0, 10**6) / 1000, 0.1, float("inf") if i == 90 else 0.3) for i in range(100)]
    for guard in (True, False):
        means = [
            sorted(map(tuple, scoring.running_mean(spark.createDataFrame(rows, METRICS).repartition(n), guard=guard, block=b, digits=4).collect()))
            for n, b in ((1, 1000), (7, 9))
        ]
        assert means[0] == means[1]
    total = sum(round(r[3] * 1000) for r in rows)
    assert means[0][-1][2] == total / 1000 / 100 and means[0][-1][4] == float("inf")


@pytest.mark.parametrize("buffer,lanes", [(20, 1), (30, 3), (1, 1)])
def test_shuffled_stream_is_a_permutation_and_repeats(spark, tmp_path, buffer, lanes):
    rows = [(i, f"text {i}") for i in range(200)]
    parts = [rows[i : i + 50] for i in range(0, 200, 50)]
    found = []
    for run in range(2):
        stream = files(spark, f"{tmp_path}/in{run}", [*parts, [(None, None)]], "sample_id long, text string")
        out = f"{tmp_path}/out{run}"
        jobs.buffer_shuffle_stream(stream, "sample_id", buffer, out, f"{tmp_path}/state{run}", lanes).awaitTermination()
        found.append(sorted(map(tuple, spark.read.parquet(out).collect())))
    assert found[0] == found[1]
    assert sorted((i, t) for _, _, i, t in found[0]) == rows
    for lane in range(lanes):
        own = [(place, i) for at, place, i, _ in found[0] if at == lane]
        assert [place for place, _ in own] == list(range(len(own)))
        arrival = {i: n for n, i in enumerate(sorted(i for _, i in own))}
        moved = [arrival[i] - place for place, i in own]
        assert max(moved) <= buffer // lanes
        assert buffer == 1 or (sum(m != 0 for m in moved) > len(own) / 2)


def test_streams_leave_the_session_as_it_was(spark):
    assert spark.conf.get(jobs._PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
