"""Properties and brute-force comparisons."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import arrays
from tokenloom.operators import align as A
from tokenloom.operators import edit_map, losses, ordering, scoring, vocab
from tokenloom.operators.lookup import lookup
from tokenloom.streaming import jobs


def plain_dtw(cost):
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(n):
        for j in range(m):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j + 1], total[i + 1, j], total[i, j])
    return total[n, m]


@pytest.mark.parametrize("seed", range(30))
def test_path_properties(seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 6, size=(rng.integers(1, 9), rng.integers(1, 9))).astype(float)
    total, path = A.dtw_path(cost)
    assert total == plain_dtw(cost) == cost[path[:, 0], path[:, 1]].sum()
    assert path[0].tolist() == [0, 0] and path[-1].tolist() == [cost.shape[0] - 1, cost.shape[1] - 1]
    moves = np.diff(path, axis=0)
    assert ((moves >= 0) & (moves <= 1)).all() and (moves.sum(axis=1) >= 1).all()
    assert set(path[:, 0]) == set(range(cost.shape[0])) and set(path[:, 1]) == set(range(cost.shape[1]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_words_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("abcé") for _ in range(rng.randint(low, high)))
    tea = sorted({word(1, 12) for _ in range(150)} | {"x" * 30, "q", "zzzzzzz"})
    stu = sorted({word(1, 9) for _ in range(120)})
    teacher = spark.createDataFrame([(t, i) for i, t in enumerate(tea)], "token string, id int")
    student = spark.createDataFrame([(t, i) for i, t in enumerate(stu)], "token string, id int")
    found = {r.src_id: (r.distance, r.dst_id) for r in edit_map.min_edit_map(teacher, student).collect()}
    expected = {i: min((distance(t, s), j) for j, s in enumerate(stu)) for i, t in enumerate(tea)}
    assert found == expected


def test_full_map_has_every_document_word(spark, tmp_path):
    """The registered map of two whole vocabularies, on small tables, against all pairs of words."""
    from tokenloom.plans.catalog import QUERIES
    from tokenloom.plans.registry import vocab_sql

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(n))
    tables = {"documents": [text(60) + " zzzzzzzzzzzz"], "conversations": [text(50)], "benchmark": ["abc"]}
    vocabs = {}
    import duckdb

    for name, texts in tables.items():
        spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/{name}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        vocabs[name] = con.execute(f"WITH {vocab_sql('v', name)} SELECT id, token FROM v").fetchall()
    found = {r.src_id: (r.distance, r.dst_id) for r in QUERIES["min_edit_map_full"](spark, str(tmp_path)).collect()}
    assert found == {i: min((distance(t, s), j) for j, s in vocabs["conversations"]) for i, t in vocabs["documents"]}


def test_salted_lookup_equals_broadcast(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    for how in ("left", "inner"):
        small = lookup(df, dim, "k", how, salt_by=["v"])
        salted = lookup(df, dim, "k", how, salt_by=["v"], broadcast_bytes=0)
        assert sorted(small.collect(), key=str) == sorted(salted.collect(), key=str)


def test_divergences(spark):
    rng = np.random.default_rng(5)
    rows = [(1, [float(x) for x in rng.normal(size=6)], [float(x) for x in rng.normal(size=6)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "sample_id int, tea_logits array<double>, stu_logits array<double>")
    kl = losses.forward_kl_step(F.col("tea_logits"), F.col("stu_logits"), 1.0)
    same = losses.sorted_distance(F.col("tea_logits"), F.col("tea_logits"))
    row = df.agg(F.min(kl).alias("kl"), F.max(same).alias("same")).first()
    assert row.kl >= 0 and row.same == 0
    total = df.select(arrays.total(arrays.softmax(F.col("tea_logits"))).alias("t")).agg(F.max(F.abs(F.col("t") - 1)).alias("e"))
    assert total.first().e < 1e-12


def test_inverse_of_inverse_is_part_of_the_map(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(8)])) for i in range(40)]
    mapping = spark.createDataFrame(rows, "src_id int, dst_id int")
    back = {tuple(r) for r in vocab.invert_last(vocab.invert_last(mapping)).collect()}
    assert back <= set(rows)


def test_index_does_not_depend_on_partitions(spark):
    one = ordering.shuffled_index(spark.range(0, 300, 1, 1), "id").collect()
    many = ordering.shuffled_index(spark.range(0, 300, 1, 23), "id").collect()
    assert sorted(one) == sorted(many)
    assert sorted(r.idx for r in one) == list(range(300))


def metric_rows(spark, low, high):
    return spark.range(low, high).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("run"),
        F.col("id").alias("step"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.sqrt("id")).alias("sft_loss"),
        F.col("id").cast("double").alias("distill_loss"),
        F.lit(0.5).alias("unmasked_rate"),
    )


def test_streams_over_several_batches_equal_the_batch_result(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    windows, window_state = str(tmp_path / "w"), str(tmp_path / "ws")
    schema = metric_rows(spark, 0, 1).schema
    for low, high in ((0, 100), (100, 101), (101, 300)):
        metric_rows(spark, low, high).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.running_mean_stream(stream, out, state).awaitTermination()
        jobs.windowed_means_stream(stream, windows, window_state).awaitTermination()
    got = spark.read.parquet(f"{out}/rows").select("run", "step", "sft_loss", "distill_loss").orderBy("step").collect()
    want = scoring.running_mean(metric_rows(spark, 0, 300), scoring.LOSSES).orderBy("step").collect()
    assert [(r.run, r.step) for r in got] == [(r.run, r.step) for r in want]
    assert [r.sft_loss for r in got] == pytest.approx([r.sft_loss for r in want])
    assert [r.distill_loss for r in got] == pytest.approx([r.distill_loss for r in want])
    latest = jobs.latest_windows(spark.read.parquet(windows)).orderBy("run", "window_start").collect()
    batch = jobs.windowed_means(metric_rows(spark, 0, 300)).orderBy("run", "window_start").collect()
    assert [(r.run, r.window_start, r.rows) for r in latest] == [(r.run, r.window_start, r.rows) for r in batch]
    assert [r.sft_loss for r in latest] == pytest.approx([r.sft_loss for r in batch])


def test_words_are_looked_up_in_place(spark):
    """No row moves below the read, and the join for large vocabularies gives the same ids."""
    from tokenloom.operators.tokenize import tokenize_words
    from tokenloom.plans.prepare import prepare_student

    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("</s>", 3)], "token string, id int")
    rows = [(1, "a b", "b zz a"), (2, "", ""), (3, "a", None), (4, None, "a " * 50)]
    df = spark.createDataFrame(rows, "sample_id long, prefix string, text string")
    prepared = prepare_student(df, "sample_id", vocab, "</s>", 8)
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    by_id = {r["sample_id"]: r for r in prepared.collect()}
    assert by_id[1]["ids"] == [1, 2, 0, 1, 3] or by_id[1]["ids"] == [1, 0, 0, 1, 3]
    assert len(by_id[1]["ids"]) == len(by_id[1]["labels"])
    args = (df, "sample_id", {"ids": F.col("text")}, vocab)
    size = {"n": F.length("prefix")}
    quick = tokenize_words(*args, limit=5, carry=size)
    joined = tokenize_words(*args, limit=5, carry=size, dictionary_bytes=0)
    pairs = [sorted((r["sample_id"], r["ids"] or [], r["n"]) for r in x.collect() if r["sample_id"] != 3) for x in (quick, joined)]
    assert pairs[0] == pairs[1]


def test_remap_and_dense_loss_are_the_same_in_both_engines(spark):
    from tokenloom.operators import candidates

    rng = random.Random(4)
    mapping = spark.createDataFrame([(i, rng.choice([None, rng.randint(1, 9)])) for i in range(1, 13)], "src_id int, dst_id int")
    learnt = spark.createDataFrame([(i, rng.randint(1, 9), rng.randint(0, 3)) for i in range(1, 13, 2)], "src_id int, dst_id int, since int")
    rows = [(s, t, [rng.gauss(0, 2) for _ in range(12)], [rng.gauss(0, 2) for _ in range(9)], s) for s in range(4) for t in range(3)]
    merged = spark.createDataFrame(rows, "sample_id int, step int, tea_logits array<double>, stu_logits array<double>, batch int").repartition(2)
    for late in (None, learnt):
        remapped = [candidates.full_vocab_remap(merged, mapping, id_base=1, learnt=late, engine=e) for e in ("sql", "arrow")]
        by_step = [{(r.sample_id, r.step): (r.tea_logits, r.stu_logits) for r in x.collect()} for x in remapped]
        assert by_step[0] == by_step[1]
        pairs = zip(remapped, ("sql", "arrow"))
        loss = [{r.sample_id: r.distill_loss for r in losses.kl_dense(x, 2.0, e).collect()} for x, e in pairs]
        assert loss[0] == pytest.approx(loss[1])


def test_a_long_sample_aligns(spark):
    """2,048 tokens a side: the work of one block."""
    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(2048)]
    other = [w if rng.random() < 0.9 else w + "x" for w in words]
    row = [(1, words, other, [1] * 2048, [1] * 2048)]
    kinds = "sample_id long, tea_tokens array<string>, stu_tokens array<string>, tea_weights array<int>, stu_weights array<int>"
    found = A.align(spark.createDataFrame(row, kinds)).first()
    assert found.status == "ok" and len(found.tea_pos) == 2048 and 2048 <= len(found.path) < 4096


def test_candidates_whose_lengths_decide_are_not_compared(spark):
    """The lengths alone rule a pair out only where its distance is at the threshold or above."""
    from tokenloom.operators import candidates

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 6, 12, 20])))
    pairs = [(word(), word()) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (0.3, 0.45):
        kept = candidates.may_be_near(F.length("a"), F.length("b"), threshold)
        marked = [tuple(r) for r in rows.select("a", "b", kept).collect()]
        assert all(near or distance(a, b) >= threshold * (len(a) + len(b)) for a, b, near in marked)
        assert sum(near for *_, near in marked) < len(pairs) * (0.5 if threshold == 0.3 else 0.6)
    sources = spark.createDataFrame([(1, 0, i, i, a) for i, (a, _) in enumerate(pairs[:40])], "sample_id int, step int, rank int, token_id int, token string")
    pool = spark.createDataFrame([(1, 0, i, i, b) for i, (_, b) in enumerate(pairs[:40])], sources.schema)
    found = {r.rank: (r.distance, r.dst_id) for r in candidates.nearest_candidate(sources, pool, 0.45, pairs={"<x>": "<y>"}).collect()}
    want = {}
    for i, (a, _) in enumerate(pairs[:40]):
        near = [(distance(a, b) / (len(a) + len(b) or 1), j) for j, (_, b) in enumerate(pairs[:40])]
        if min(near)[0] < 0.45:
            want[i] = min(near)
    assert found == want
