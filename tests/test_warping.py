"""Warping in linear memory, token distances, and samples dealt out by size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import warping
from tokenloom.operators import align as A
from tokenloom.plans.queries_align import document_samples


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def plain_path(cost):
    """The whole table, and the way back: diagonal, up, left."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    ways = lambda i, j: [total[i, j], total[i, j + 1], total[i + 1, j]]
    for i in range(n):
        for j in range(m):
            total[i + 1, j + 1] = cost[i, j] + (min(ways(i, j)) if i or j else 0)
    i, j = n - 1, m - 1
    path = [(i, j)]
    while i or j:
        move = int(np.argmin(ways(i, j)))
        i, j = i - (move != warping.LEFT), j - (move != warping.UP)
        path.append((i, j))
    return total[n, m], path[::-1]


@pytest.mark.parametrize("bytes_kept", [1 << 25, 60, 5])
def test_paths_are_the_same_in_halves_and_in_groups(monkeypatch, bytes_kept):
    monkeypatch.setattr(warping, "MOVE_BYTES", bytes_kept)
    rng = np.random.default_rng(bytes_kept)
    samples, want = [], []
    for k in range(60):
        n, m = rng.integers(1, 16, 2)
        table = rng.integers(0, 3, (5, 4)).astype(float)  # ties everywhere
        rows, cols = rng.integers(0, 5, n), rng.integers(0, 4, m)
        weights = (rng.integers(3, 6, n), rng.integers(3, 6, m)) if k % 2 else (None, None)
        cost = table[rows][:, cols]
        want.append(plain_path(cost if k % 2 == 0 else cost * weights[0][:, None] * weights[1]))
        samples.append(warping.Sample(table, rows, cols, *weights))
    found = warping.warp_all(samples)
    assert [(total, [tuple(c) for c in path.tolist()]) for total, path in found] == want
    assert warping.warp_all([]) == []


def test_memory_grows_with_the_lengths_only(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(warping, "MOVE_BYTES", 1 << 18)
    rng = np.random.default_rng(0)
    sample = warping.Sample(rng.random((50, 50)), rng.integers(0, 50, 4000), rng.integers(0, 50, 4000))
    tracemalloc.start()
    (_, path), = warping.warp_all([sample])  # 16 million moves
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()
    steps = np.diff(path, axis=0)
    assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (3999, 3999) and set(map(tuple, steps)) <= {(1, 1), (1, 0), (0, 1)}


def test_distances_of_awkward_tokens():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    left = [word(n) for n in (0, 1, 2, 3, 5, 8, 9, 40, 300)] + ["", "abc", "x" * 700]
    right = [word(n) for n in (0, 0, 1, 4, 7, 16, 17, 260)]
    a, b = (v.ravel() for v in np.meshgrid(range(len(left)), range(len(right)), indexing="ij"))
    found = warping.edit_distances(left, right, (a, b))
    assert found.tolist() == [distance(left[i], right[j]) for i, j in zip(a, b)]
    assert warping.edit_distances([], [], (np.zeros(0, int), np.zeros(0, int))).tolist() == []


@pytest.mark.parametrize("kept", [4096, 5])
@pytest.mark.parametrize("norm", [False, True])
def test_known_distances_do_not_change_costs(monkeypatch, kept, norm):
    monkeypatch.setattr(warping, "KEPT_TOKENS", kept)
    costs = warping.TokenCosts(norm, "_", "G", "marker" if norm else "both", {"</s>": "<end>"})
    rng = random.Random(kept)
    words = ["_ab", "Gab", "</s>", "<end>", "a b", "", "_", "G"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(20)]
    strip = (lambda t, m: t.replace(m, "")) if norm else (lambda t, m: t.replace(m, "").replace(" ", ""))
    for _ in range(6):
        tea, stu = ([rng.choice(words) for _ in range(rng.randint(1, 15))] for _ in range(2))
        table, rows, cols = costs.table(tea, stu)
        for i, t in enumerate(tea):
            for j, s in enumerate(stu):
                x, y = strip(t, "_"), strip(s, "G")
                want = distance(x, y) / (len(x) + len(y) or 1 if norm else 1)
                if (t, s) in (("</s>", "<end>"), ("<end>", "</s>")):
                    want = 0
                assert table[rows[i], cols[j]] == want


def test_samples_are_dealt_out_by_cells(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([3, 30, 300, 300]), rng.choice([5, 50, 400])) for i in range(600)]
    samples = spark.createDataFrame(sizes, "sample_id long, n int, m int").select(
        "sample_id", F.array_repeat(F.lit("a"), F.col("n")).alias("tea_tokens"), F.array_repeat(F.lit("b"), F.col("m")).alias("stu_tokens")
    )
    dealt = A.deal(samples, 8)
    cells = dealt.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sum(F.size("tea_tokens") * F.size("stu_tokens")).alias("cells"))
    found = sorted(r["cells"] for r in cells.collect())
    assert len(found) == 8 and found[-1] <= 1.2 * found[4] and dealt.count() == 600 and dealt.columns == samples.columns


def test_documents_aligned_in_two_tokenizations(spark):
    docs = [(1, "the cat sat"), (2, ""), (3, None), (4, "at the  at"), (5, "zzz the")]
    pieces = spark.createDataFrame([("th", 1), ("e", 2), ("at", 3), ("c", 4), ("s", 5), ("a", 6), ("t", 7)], "token string, id int")
    samples = document_samples(spark.createDataFrame(docs, "sample_id long, text string"), pieces)
    cut = {r.sample_id: (r.tea_tokens, r.stu_tokens) for r in samples.collect()}
    assert cut[1] == (["the", "cat", "sat"], ["th", "e", "c", "at", "s", "at"]) and cut[5] == (["zzz", "the"], ["�"] * 3 + ["th", "e"])
    rows = {r.sample_id: r for r in A.align(A.deal(samples, 3), cost="norm").collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and {i: rows[i].status for i in (2, 3)} == {2: "empty_student", 3: "empty_student"}
    for i in (1, 4, 5):
        tea, stu = cut[i]
        cost = np.array([[distance(t, s.replace("Ġ", "")) / (len(t) + len(s)) for s in stu] for t in tea])
        total, path = plain_path(cost)
        assert rows[i].total_cost == pytest.approx(total) and [tuple(c) for c in rows[i].path] == path


def test_documents_are_read_to_their_end(spark):
    pieces = spark.createDataFrame([("a", 1), ("b", 2), ("cd", 3)], "token string, id int")
    text = "ab " * 2100 + "cd"
    (row,) = document_samples(spark.createDataFrame([(1, text)], "sample_id long, text string"), pieces).collect()
    assert row.tea_tokens == text.split() and row.stu_tokens == ["a", "b"] * 2100 + ["cd"]


def test_a_long_sample_is_gone_through_about_once(monkeypatch):
    rng = np.random.default_rng(3)
    sample = warping.Sample(rng.integers(0, 4, (30, 20)) / 4, rng.integers(0, 30, 700), rng.integers(0, 20, 900))
    (want,) = warping.warp_all([sample])
    cells, costs = [], warping._Warp.costs

    def counted(self, *args):
        cells.append(costs(self, *args))
        return cells[-1]

    monkeypatch.setattr(warping, "MOVE_BYTES", 1 << 16)
    monkeypatch.setattr(warping._Warp, "costs", counted)
    ((total, path),) = warping.warp_all([sample])
    assert total == want[0] and path.tolist() == want[1].tolist()
    assert sum(c.size for c in cells) < 1.5 * 700 * 900


@pytest.mark.parametrize("listed", [1 << 20, 5])
def test_distances_of_many_samples_are_found_together(monkeypatch, listed):
    monkeypatch.setattr(warping, "_VALUES", listed)
    rng, calls, found = random.Random(2), [], warping.edit_distances
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(80)] + ["</s>", "<end>"]
    samples = [tuple([rng.choice(words) for _ in range(rng.randint(1, 40))] for _ in range(2)) for _ in range(30)]
    costs = lambda: warping.TokenCosts(True, "_", "G", "marker", {"</s>": "<end>"})
    want = [costs().table(*s) for s in samples]
    monkeypatch.setattr(warping, "edit_distances", lambda *a: calls.append(len(a[2][0])) or found(*a))
    for (codes, rows, cols, values), alone in zip(costs().tables(samples), want):
        table = codes if values is None else values.take(codes)
        assert (values is None) == (listed == 5) and table[rows][:, cols].tolist() == alone[0][alone[1]][:, alone[2]].tolist()
    assert len(calls) == 1


def test_samples_are_made_once_to_be_aligned(spark):
    rows = [(1, ["a", "b"], ["a"]), (2, [], ["a"]), (3, ["a"], []), (4, None, ["a"]), (5, ["a"], None), (6, [], [])]
    samples = spark.createDataFrame(rows, "sample_id long, tea_tokens array<string>, stu_tokens array<string>")
    aligned = A.align(samples, cost="norm")
    assert "Union" not in aligned._jdf.queryExecution().executedPlan().toString()
    found = {r.sample_id: r for r in aligned.collect()}
    assert {i: r.status for i, r in found.items()} == {
        1: "ok", 2: "empty_teacher", 3: "empty_student", 4: "empty_teacher", 5: "empty_student", 6: "empty_student"
    }
    assert [tuple(p) for p in found[1].path] == [(0, 0), (1, 0)] and found[1].tea_pos == [0, 1]
    assert all(found[i][c] is None for i in range(2, 7) for c in ("total_cost", "path", "tea_spans", "stu_spans"))
    assert found[2].tea_pos == [] and found[2].stu_pos == [0] and found[4].tea_pos is None


def test_texts_are_dealt_out_by_the_cells_of_their_samples(spark):
    pieces = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int")
    docs = spark.createDataFrame([(i, "ab " * (100 if i % 7 == 0 else 2)) for i in range(70)] + [(99, None)], "sample_id long, text string")
    dealt = A.deal(docs, 5, A.sample_cells(document_samples(docs, pieces)))
    assert dealt.columns == docs.columns and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, docs.collect()))
    long = dealt.filter("sample_id % 7 = 0").groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in long] == [2] * 5
    plan = document_samples(dealt, pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Repartition")  # tokens are made of texts that have moved
