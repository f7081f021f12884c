"""Hand-worked inputs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tokenloom.functions import arrays, text
from tokenloom.operators import align as A
from tokenloom.operators import candidates as C
from tokenloom.operators import collate, labels, losses, ordering, scoring, templates, tokenize, vocab
from tokenloom.plans import distill, prepare
from tokenloom.sources import corpus, vocab_map


def cell(spark, expression, rows=None, schema=None):
    df = spark.range(1) if rows is None else spark.createDataFrame(rows, schema)
    return df.select(expression.alias("x")).first().x


def samples(spark, *rows):
    return spark.createDataFrame(
        [(i, t, s, [1] * len(t), [1] * len(s)) for i, (t, s) in enumerate(rows)],
        "sample_id long, tea_tokens array<string>, stu_tokens array<string>, tea_weights array<int>, stu_weights array<int>",
    )


def paths(df):
    return {r.sample_id: [(p.i, p.j) for p in r.path] for r in df.filter("status = 'ok'").collect()}


def test_path_of_single_cells_and_one_to_many(spark):
    found = paths(A.align(samples(spark, (["a"], ["b"]), (["ab"], ["a", "b"]))))
    assert found == {0: [(0, 0)], 1: [(0, 0), (0, 1)]}


def test_ties_go_diagonal_then_up_then_left():
    total, path = A.dtw_path(np.zeros((2, 2)))
    assert total == 0 and path.tolist() == [[0, 0], [1, 1]]
    _, path = A.dtw_path(np.zeros((3, 2)))
    assert path.tolist() == [[0, 0], [1, 0], [2, 1]]
    _, path = A.dtw_path(np.zeros((2, 3)))
    assert path.tolist() == [[0, 0], [0, 1], [1, 2]]


def test_groups_may_overlap(spark):
    rows = spark.createDataFrame(
        [Row(sample_id=1, tea_spans=[Row(lo=0, hi=1), Row(lo=1, hi=2), Row(lo=3, hi=3), Row(lo=3, hi=3)])]
    )
    found = [(r.step, r.members) for r in A.distinct_groups(rows).orderBy("step").collect()]
    assert found == [(0, [0, 1]), (1, [1, 2]), (2, [3])]


def test_flat_entropy_has_weight_three(spark):
    steps = spark.createDataFrame([(1, "t", p, [1.0, 2.0]) for p in range(3)], "sample_id int, side string, pos int, logits array<double>")
    assert {r.weight for r in A.entropy_weight(steps, ["sample_id", "side"]).collect()} == {3}


def test_weight_buckets(spark):
    rows = [(1, p, x) for p, x in enumerate((0.0, 0.3268, 0.6733, 1.0, 0.3266, 0.6732))]
    df = A.weight_of_entropy(spark.createDataFrame(rows, "sample_id int, pos int, entropy double"), ["sample_id"])
    assert [r.weight for r in df.orderBy("pos").collect()] == [3, 4, 5, 5, 3, 4]


def test_truncated_response_has_no_labels(spark):
    tokens = spark.createDataFrame([(1, 3, [5, 6, 7, 8, 9])], "sample_id long, prompt_size int, text array<int>")
    row = prepare.label_rows(tokens, "sample_id", "student", 3, masked=True).first()
    assert row.ids == [5, 6, 7] and row.labels == [-100] * 3 and row.mask == [1] * 3


def test_samples_without_content_are_marked(spark):
    rows = {r.sample_id: r.status for r in A.align(samples(spark, (["a"], []), ([], ["a"]), (["a"], ["a"]))).collect()}
    assert rows == {0: "empty_student", 1: "empty_teacher", 2: "ok"}


def test_empty_and_special_tokens(spark):
    assert cell(spark, text.edit_distance_norm(F.lit(" "), F.lit(""))) == 0
    assert cell(spark, text.edit_cost(F.lit("</s>"), F.lit("<|im_end|>"))) == 0
    assert cell(spark, text.edit_cost(F.lit("<|endoftext|>"), F.lit("</s>"))) == 0
    assert cell(spark, text.edit_cost(F.lit("_ab "), F.lit("Ġac"))) == 1
    assert cell(spark, text.edit_cost(F.lit("über"), F.lit("uber"))) == 1


def test_word_markers():
    assert text.word_marker("bert", teacher=True) == "##" and text.word_marker("qwen2", teacher=False) == "Ġ"
    assert text.word_marker(None, teacher=True) == "_" and text.word_marker("other", teacher=False) == "Ġ"


def test_inverse_maps(spark):
    mapping = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "src_id int, dst_id int")
    assert [tuple(r) for r in vocab.invert_last(mapping).collect()] == [(7, 2)]
    assert {r.stu_id: r.tea_ids for r in vocab.invert_first_k(mapping, 1).collect()} == {7: [1], 0: [3]}
    assert {r.stu_id: r.tea_ids for r in vocab.invert_first_k(mapping, 3).collect()} == {7: [1, 2, 2], 0: [3, 3, 3]}
    dense = {r.src_id: r.dst_id for r in vocab.densify(mapping, 5).collect()}
    assert dense == {0: 0, 1: 7, 2: 7, 3: 0, 4: 0}


def test_nothing_mapped(spark):
    pairs = spark.createDataFrame(
        [(1, 0, "t2s", 1, 4, None), (1, 0, "s2t", 1, 5, None)],
        "sample_id int, step int, direction string, rank int, src_id int, dst_id int",
    )
    assert C.unmasked_rate(pairs).first().unmasked_rate == 0
    merged = spark.createDataFrame([(1, 0, [1.0, 2.0], [3.0, 4.0])], "sample_id int, step int, tea_logits array<double>, stu_logits array<double>")
    gathered = C.gather_logits(pairs, merged)
    assert {(p.tea_logit, p.stu_logit) for p in gathered.first().pairs} == {(-10000.0, -10000.0)}
    assert math.isfinite(losses.kl_topk(gathered, 2.0).first().distill_loss)


def test_sorted_distance_pads_the_narrower_vocabulary(spark):
    same = losses.sorted_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(-1000.0)))
    assert cell(spark, same) == pytest.approx(0)
    wide = losses.sorted_distance(F.array(F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))
    assert cell(spark, wide) == pytest.approx(1.0)


def test_running_mean_counts_rows_that_are_not_finite(spark):
    rows = [("r", 0, 1.0), ("r", 1, float("nan")), ("r", 2, 3.0)]
    df = spark.createDataFrame(rows, "run string, step long, sft_loss double").withColumn("distill_loss", F.col("sft_loss"))
    for block in (1, 2, 100):
        out = scoring.running_mean(df, scoring.LOSSES, block=block).orderBy("step").collect()
        assert [r.sft_loss for r in out] == pytest.approx([1, 0.5, 4 / 3])


def test_last_proposal_wins_per_sample_and_first_per_run(spark):
    rows = [(1, 0, 1, 9, 3), (1, 2, 1, 9, 4), (1, 2, 5, 9, 5), (2, 0, 1, 9, 6)]
    df = spark.createDataFrame(rows, "sample_id int, step int, rank int, src_id int, dst_id int")
    assert {tuple(r) for r in C.dynamic_map_last(df).collect()} == {(1, 9, 5), (2, 9, 6)}
    first = C.dynamic_map_first(df.withColumn("batch", F.col("sample_id"))).first()
    assert (first.src_id, first.dst_id, first.since) == (9, 3, 1)


def test_modes_of_matching_differ_where_they_should(spark):
    schema = "sample_id int, step int, rank int, token_id int, logit double, token string"
    teacher = spark.createDataFrame([(1, 0, 1, 1, 5.0, "abcde"), (1, 0, 2, 2, 4.0, "zzzzz")], schema)
    student = spark.createDataFrame([(1, 0, 1, 1, 5.0, "abcdx"), (1, 0, 2, 3, 4.0, "zzzzy")], schema)
    none = spark.createDataFrame([], "src_id int, dst_id int")

    def run(mode):
        found = C.match_both(teacher, student, none, none, 2, 2, 0.3, pool=mode, first_id=1)
        return {(r.direction, r.src_id): r.dst_id for r in found.collect()}

    # Student id 1 is, read as a teacher id, unmapped; so the published pool lacks it, and
    # what the first pass left unmatched is lost to the second one as well.
    assert run("published") == {("t2s", 1): None, ("t2s", 2): 3, ("s2t", 1): None, ("s2t", 3): None}
    assert run("clean") == {("t2s", 1): 1, ("t2s", 2): 3, ("s2t", 1): 1, ("s2t", 3): 2}


def test_crossed_halves(spark):
    pairs = F.array(
        F.struct(F.lit("t2s").alias("direction"), F.lit(1.0).alias("tea_logit"), F.lit(2.0).alias("stu_logit")),
        F.struct(F.lit("s2t").alias("direction"), F.lit(3.0).alias("tea_logit"), F.lit(4.0).alias("stu_logit")),
    )
    published, clean = losses.pair_vectors(pairs), losses.pair_vectors(pairs, "clean")
    assert [cell(spark, v) for v in published] == [[1.0, 4.0], [2.0, 3.0]]
    assert [cell(spark, v) for v in clean] == [[1.0, 3.0], [2.0, 4.0]]


def test_nearest_needs_a_distance_strictly_below_the_threshold(spark):
    schema = "sample_id int, step int, rank int, token_id int, logit double, token string"
    source = spark.createDataFrame([(1, 0, 1, 1, 1.0, "abcde")], schema)
    pool = spark.createDataFrame([(1, 0, 1, 8, 1.0, "abcdx"), (1, 0, 2, 7, 1.0, "abcdy")], schema)
    assert C.nearest_candidate(source, pool, 0.1).count() == 0
    assert C.nearest_candidate(source, pool, 0.11).first().dst_id == 7


def test_topk_engines_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 5, 40)]) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_id int, logits array<double>")
    sql = C.topk(df, 7).orderBy("sample_id", "rank").collect()
    assert sql == C.topk(df, 7, engine="arrow").orderBy("sample_id", "rank").collect()


def test_record_shapes_and_block_size():
    assert templates.record_shape(["prefix", "text"]) == "prefix"
    assert templates.record_shape(["instruction", "input", "output"]) == "instruction"
    assert templates.record_shape(["body"]) == "plain"
    with pytest.raises(ValueError):
        templates.record_shape(["input"])
    assert templates.resolve_text_column(["a", "text"]) == "text"
    assert templates.resolve_text_column(["a", "b"]) == "a"
    assert templates.resolve_block_size(None, 4096) == 1024
    assert templates.resolve_block_size(2048, 512) == 512


def test_replaced_teacher_text_exists_for_prefix_records_only(spark):
    words = spark.createDataFrame([("a", 1), ("<|im_end|>", 2)], "token string, id int")
    plain = spark.createDataFrame([(1, "a")], "sample_id long, text string")
    prefix = spark.createDataFrame([(1, "a ", "a")], "sample_id long, prefix string, text string")
    args = ("sample_id", words, "</s>", ["<|im_end|>"], 8)
    assert prepare.prepare_teachers(plain, *args, method="replace").count() == 0
    row = prepare.prepare_teachers(prefix, *args, method="replace").first()
    assert row.ids == [1, 1, 2] and row.labels == [-100, 1, 2]


def test_masked_lm_student_has_no_labels_yet(spark):
    words = spark.createDataFrame([("a", 1), ("</s>", 2)], "token string, id int")
    rows = spark.createDataFrame([(1, "a ", "a")], "sample_id long, prefix string, text string")
    row = prepare.prepare_student(rows, "sample_id", words, "</s>", 8, is_mlm=True).first()
    assert row.ids == [1, 1] and row.labels is None


def test_response_start_and_rotation(spark):
    marked = F.array(*[F.lit(x) for x in (-100, -100, 0, 5, 6)])
    assert cell(spark, labels.response_start(marked)) == 2
    assert cell(spark, labels.response_start(marked, pad_id=0)) == 3
    assert cell(spark, arrays.rotated(marked, F.lit(3))) == [5, 6, -100, -100, 0]


def test_text_files_keep_line_ends(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\n\ntwo\n")
    assert [r.text for r in corpus.read_corpus(spark, str(tmp_path / "x.txt")).collect()] == ["one\n", "\n", "two\n"]
    kept = corpus.read_corpus(spark, str(tmp_path / "x.txt"), keep_linebreaks=False)
    assert [r.text for r in kept.collect()] == ["one", "", "two"]
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, "x.pdf")


def test_map_file_round_trip(spark, tmp_path):
    mapping = spark.createDataFrame([(0, 5), (1, None), (10, 2)], "src_id int, dst_id int")
    vocab_map.write_vocab_map(mapping, str(tmp_path / "m"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert written.replace("\n", "") == '{"0":5,"1":0,"10":2}'
    assert json.loads(written) == {"0": 5, "1": 0, "10": 2}
    vocab_map.write_vocab_map(mapping.limit(0), str(tmp_path / "none"))
    assert vocab_map.read_vocab_map(spark, str(tmp_path / "none")).count() == 0
    again = vocab_map.read_vocab_map(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in again.collect()} == {(0, 5), (1, None), (10, 2)}


def test_outside_tokenizer(spark):
    def make():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    rows = spark.createDataFrame([(1, "ab c"), (2, None)], "sample_id long, text string")
    out = {r.sample_id: r.text for r in tokenize.tokenize_with(rows, "sample_id", ["text"], make).collect()}
    assert out == {1: [2, 1], 2: []}


def test_longest_match_takes_the_longest_piece(spark):
    pieces = spark.createDataFrame([("un", 1), ("unh", 2), ("happy", 3), ("h", 4)], "token string, id int")
    tokens = spark.createDataFrame([("unhappy",), ("happyx",)], "token string")
    found = {r.token: r.pieces for r in tokenize.longest_match_words(tokens, pieces).collect()}
    assert found == {"unhappy": [2, 0, 0, 0, 0], "happyx": [3, 0]}


def test_splits_cover_everything(spark):
    df = spark.range(0, 1000, 1, 7)
    out = ordering.percent_split(df, "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"validation": 50, "train": 950}
    few = ordering.percent_split(spark.range(5), "id")
    assert few.filter("split = 'validation'").count() == 0


def test_batch_padding_sides(spark):
    tokens = spark.createDataFrame(
        [(1, [1], [1], [-100]), (2, [1, 2, 3], [1, 1, 1], [1, 2, 3])], "id int, ids array<int>, mask array<int>, labels array<int>"
    )
    batches = spark.createDataFrame([(1, 0), (2, 0)], "id int, batch long")
    left = {r.id: r for r in collate.pad_batch(tokens, batches, "id", 9, multiple=4).collect()}
    assert left[1].ids == [9, 9, 9, 1] and left[2].labels == [-100, 1, 2, 3] and left[1].mask == [0, 0, 0, 1]
    right = {r.id: r for r in collate.pad_teacher(tokens, batches, "id", 9).collect()}
    assert right[1].ids == [1, 9, 9]


def test_answers_and_subsequence(spark):
    assert cell(spark, scoring.final_answer(F.lit("x\n#### -1,234"))) == "-1234"
    assert cell(spark, scoring.final_answer(F.lit("none"))) is None
    rows = [("the cat sat down", "the dog sat"), ("", "a")]
    df = scoring.rouge_l(spark.createDataFrame(rows, "prediction string, reference string"))
    first, empty = df.collect()
    assert first.precision == 0.5 and first.recall == pytest.approx(2 / 3) and empty.rouge_l == 0


def test_wide_engine_agrees(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 4, i, 1, [float(x) for x in rng.normal(size=9)], [float(x) for x in rng.normal(size=7)], i % 7) for i in range(24)]
    schema = "sample_id int, pos int, mask int, tea_logits array<double>, stu_logits array<double>, label int"
    df = spark.createDataFrame(rows, schema)
    both = [{e: fn(e).orderBy("sample_id").collect() for e in losses.ENGINES} for fn in (
        lambda e: losses.cross_entropy(df, "stu_logits", engine=e),
        lambda e: A.entropy_weight(df.select("sample_id", "pos", "tea_logits"), ["sample_id"], "tea_logits", e).orderBy("sample_id", "pos"),
        lambda e: losses.kl_forward(df, 2.0, engine=e).withColumn("sample_id", F.lit(0)),
        lambda e: losses.kl_reverse(df, 2.0, engine=e).withColumn("sample_id", F.lit(0)),
        lambda e: losses.sorted_probability_loss(
            df.withColumn("rpos", F.col("pos")).withColumnRenamed("tea_logits", "logits"),
            df.withColumn("rpos", F.col("pos")).withColumnRenamed("stu_logits", "logits"), e),
    )]
    for found in both:
        assert len(found["sql"]) == len(found["arrow"]) > 0
        numbers = {e: sorted(v for r in rows for v in r if isinstance(v, float)) for e, rows in found.items()}
        assert numbers["sql"] == pytest.approx(numbers["arrow"])


def step_table(spark, rows):
    """Steps over three-token vocabularies: (sample, side, pos, id)."""
    vectors = {1: [3.0, 1.0, 0.5], 2: [0.5, 3.0, 1.0], 3: [1.0, 0.5, 3.0], 9: [2.0, 2.5, 1.0]}
    schema = "sample_id long, side string, pos int, token_id int, logits array<double>"
    return spark.createDataFrame([(s, side, p, t, vectors[t]) for s, side, p, t in rows], schema)


@pytest.fixture(scope="module")
def three(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, id int")
    return distill.Sides.of(vocab, vocab, 3, 3)


WHOLE = [(1, side, p, t) for side in ("teacher", "student") for p, t in enumerate((1, 2, 3))]


def losses_of(steps, three):
    batches = steps.select("sample_id", F.col("sample_id").alias("batch")).distinct()
    for loss in (
        distill.contextual_loss(steps, three, k=2),
        distill.first_wins_loss(steps, batches, three, k=2),
        distill.per_step_loss(steps, three, k=2),
    ):
        yield {r.sample_id: (r.status, r.distill_loss) for r in loss.collect()}


def test_step_numbers_may_be_sequence_positions(spark, three):
    near = list(losses_of(step_table(spark, WHOLE), three))
    moved = [(s, side, 5 + 2 * p + (side == "student"), t) for s, side, p, t in WHOLE]
    far = list(losses_of(step_table(spark, moved), three))
    for a, b in zip(near, far):
        assert a.keys() == b.keys() == {1} and a[1][0] == "ok" and a[1][1] == pytest.approx(b[1][1])


def test_samples_without_content_keep_a_row(spark, three):
    rows = WHOLE + [(2, "teacher", 0, 1), (3, "student", 0, 1)]
    for found in losses_of(step_table(spark, rows), three):
        assert {s: status for s, (status, _) in found.items()} == {1: "ok", 2: "empty_student", 3: "empty_teacher"}
        assert found[1][1] is not None and found[2][1] is None and found[3][1] is None


def test_unknown_ids_survive(spark, three):
    rows = [(1, side, p, 9 if (side, p) == ("teacher", 1) else t) for _, side, p, t in WHOLE]
    for found in losses_of(step_table(spark, rows), three):
        assert found[1][0] == "ok" and found[1][1] is not None


def test_content_steps_pair_ids_with_their_vectors(spark):
    rows = spark.createDataFrame([(1, "student", [7, 8, 9], [-100, 8, 9])], "sample_id long, side string, ids array<int>, labels array<int>")
    logits = spark.createDataFrame([(1, "student", p, [float(p)]) for p in range(3)], "sample_id long, side string, pos int, logits array<double>")
    assert sorted((r.pos, r.token_id, r.logits) for r in distill.content_steps(rows, logits).collect()) == [(1, 8, [1.0]), (2, 9, [2.0])]


def test_batch_rate_is_the_mean_over_its_samples(spark):
    losses = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, None)], "sample_id long, unmasked_rate double")
    batches = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "sample_id long, batch int")
    assert distill.batch_rate(losses, batches).first().unmasked_rate == 0.75
