"""What a task holds and what is moved stays bounded while tables grow."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import trie, warping
from tokenloom.functions.warping import TokenCosts
from tokenloom.operators import align, lookup, tokenize
from tokenloom.plans import prepare
from tokenloom.streaming import jobs


def test_long_samples_of_a_batch_are_solved_part_by_part(monkeypatch):
    rng = np.random.default_rng(3)
    words = [[f"w{k}" for k in rng.integers(0, 90, size)] for size in rng.integers(1, 60, 40)]
    other = [[w + "x" * int(rng.integers(0, 2)) for w in row] for row in words]
    none = pa.nulls(40, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(40)), pa.array(words), pa.array(other), none, none, pa.array([[0]] * 40), pa.array([[0]] * 40)],
        names=["sample_id", "tea_tokens", "stu_tokens", "tea_weights", "stu_weights", "tea_pos", "stu_pos"],
    )
    costs = lambda: TokenCosts(True, "_", "", "marker", {})
    whole = list(align._align_batches(costs)(iter([batch])))
    monkeypatch.setattr(align, "TABLE_CELLS", 4000)
    parts = list(align._align_batches(costs)(iter([batch])))
    assert len(whole) == 1 and len(parts) > 5
    assert pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()


def test_a_task_forgets_rare_tokens(monkeypatch):
    monkeypatch.setattr(warping, "KEPT_TOKENS", 8)
    bounded = TokenCosts(False, "_", "", "both", {})
    for k in range(50):
        left, right = [f"a{k}", "b", f"c{k % 3}"], [f"a{k}", "bb"]
        table, rows, cols = bounded.table(left, right)
        fresh, i, j = TokenCosts(False, "_", "", "both", {}).table(left, right)
        assert (table[np.ix_(rows, cols)] == fresh[np.ix_(i, j)]).all()
        assert len(bounded.sides[0].texts) <= 8 + 3


def test_only_keys_with_many_rows_are_repeated(spark):
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(400)] + [(None, 400)], "k string, v long")
    dim = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 800, 2)]], "k string, x int")
    for how in ("left", "inner"):
        want = sorted(map(str, rows.join(dim, "k", how).select("k", "v", "x").collect()))
        found = lookup.lookup(rows, dim, "k", how, salt_by=["v"], broadcast_bytes=0, hot_rows=50)
        assert sorted(map(str, found.select("k", "v", "x").collect())) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0, 31" not in plan


TEXTS = [(1, "a b zz a", "b"), (2, "", ""), (3, None, "q q"), (4, "zz zz yy xx b", "xx a"), (5, "c " * 300, "zz c")]
VOCAB = [("a", 1), ("b", 2), ("c", 3), ("xx", 4), ("zz", 5)]


@pytest.mark.parametrize("size", [0, 30, 64])
def test_open_words_move_once_for_a_text(spark, monkeypatch, size):
    """Broadcast whole, in part or not at all: the same ids, also of nulls, of several texts and of a repeated key."""
    df = spark.createDataFrame([*TEXTS, (1, "yy zz", "a")], "sample_id long, text string, more string")
    vocab = spark.createDataFrame(VOCAB, "token string, id int")
    args = (df, "sample_id", {"ids": F.col("text"), "more": F.col("more")}, vocab)
    whole, part = (tokenize.tokenize_words(*args, carry={"n": F.length("text")}, dictionary_bytes=b) for b in (1 << 20, size))
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))
    moved = []
    real = tokenize.lookup
    monkeypatch.setattr(tokenize, "lookup", lambda rows, *a, **k: moved.append(rows.count()) or real(rows, *a, **k))
    tokenize.tokenize_words(df, "sample_id", {"ids": F.col("text")}, vocab, dictionary_bytes=0)
    assert moved == [3 + 4 + 1 + 2]


def test_batches_are_coded_in_portions(monkeypatch):
    lists = pa.array([["ab"] * 5, None, [], ["c"], ["d"] * 30, ["e", "f"]])
    monkeypatch.setattr(tokenize, "VALUES_AT_ONCE", 6)
    portions = list(tokenize._portions(lists, tokenize._sizes(lists)))
    assert [len(p) for p in portions] == [4, 1, 1] and pa.concat_arrays(portions) == lists


def test_a_filter_on_ids_codes_a_text_once(spark):
    vocab = spark.createDataFrame(VOCAB, "token string, id int")
    df = spark.createDataFrame([(t[0], t[1]) for t in TEXTS], "sample_id long, text string")
    coded = tokenize.tokenize_words(df, "sample_id", {"ids": F.col("text")}, vocab).filter(F.size("ids") > 2)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r.sample_id for r in coded.collect()) == [1, 4, 5]


def test_both_borders_in_one_pass(spark):
    pieces = spark.createDataFrame([("ab", 1), ("a", 2), ("b", 3), ("</s>", 4)], "token string, id int")
    df = spark.createDataFrame([(1, "a", "b a"), (2, "ab ", "b")], "sample_id long, prefix string, text string")
    coder = prepare.piece_coder(pieces)
    texts = prepare.prompt_and_text(df, "sample_id", "</s>")
    both = prepare.both_borders(texts, "sample_id", {"text": F.col("text")}, F.col("prompt"), ["</s>"], 8, coder)
    for border in ("count", "offset"):
        one = prepare.coded_sides(texts, "sample_id", {"text": F.col("text")}, F.col("prompt"), ["</s>"], 8, coder, border)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.select("sample_id", "text", f"text_{border}").collect()))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_a_stream_is_prepared_with_a_large_vocabulary(spark, tmp_path, monkeypatch):
    vocab = spark.createDataFrame(VOCAB, "token string, id int")
    rows = [(i, f"a zz{i % 3} zz", "b c") for i in range(12)]
    schema = "sample_id long, prefix string, text string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    batch = prepare.prepare_student(spark.createDataFrame(rows, schema), "sample_id", vocab, "</s>", 8)
    monkeypatch.setattr(tokenize.tokenize_words, "__defaults__", (*tokenize.tokenize_words.__defaults__[:-1], 0))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.prepare_stream(
        stream, lambda df: prepare.prepare_student(df, "sample_id", vocab, "</s>", 8), f"{tmp_path}/out", f"{tmp_path}/state"
    ).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.select("batch").distinct().count() > 1
    assert sorted(map(str, found.drop("batch").collect())) == sorted(map(str, batch.collect()))


def test_words_are_compared_with_few_tokens(monkeypatch):
    """Of a vocabulary of syllables, letter by letter only near ones; words of foreign letters count as one."""
    rng = random.Random(6)
    syllables = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    word = lambda low, high: "".join(rng.choice(syllables) for _ in range(rng.randint(low, high)))
    tokens = sorted({word(1, 5) for _ in range(20_000)})
    near = sorted({word(2, 5) for _ in range(2_000)} - set(tokens))
    far = [f"{i:016d}" for i in range(2_000)] + [word(9, 9) for _ in range(20)] + ["x" * 70 + word(2, 3)]
    met = {"pairs": 0}
    compare, whole = trie._Words._compare, trie._Words._compare_whole

    def counted(self, words, found, radius):
        met["pairs"] += len(found)
        compare(self, words, found, radius)

    def counted_whole(self, words, found):
        met["pairs"] += sum(map(len, found)) * (0 < self.size <= 64)
        whole(self, words, found)

    monkeypatch.setattr(trie._Words, "_compare", counted)
    monkeypatch.setattr(trie._Words, "_compare_whole", counted_whole)
    distances, ids = trie.Bands(tokens, range(len(tokens))).nearest(near + far)
    assert met["pairs"] < len(near + far) * len(tokens) / 50

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for i in [0, 1, 2, len(near), len(near) + 2_000, len(near + far) - 1]:
        want = min((distance((near + far)[i], t), k) for k, t in enumerate(tokens))
        assert (distances[i], ids[i]) == want
