"""The tables a run needs, derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.ordering import global_index
from tokenloom.operators.vocab import added_tokens, ranked_vocab, token_counts, vocab_head
from tokenloom.session import materialize

TEA_WIDTH, STU_WIDTH = 128, 64  # two whole vectors and one
STUDENT_EOS = "</s>"
TEACHER_EOS = "<|im_end|>"
SECOND_TEACHER_EOS = "<|endoftext|>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_key() -> Column:
    """One number for a conversation and a turn; different pairs get different numbers."""
    return F.expr("(conv_id + turn) * (conv_id + turn + 1) div 2 + turn")


def prefix_samples(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``(sample_id, prefix, text)``: a user turn and the assistant turn after it.

    Turns meet by an equi join on (conversation, turn), so a long conversation is spread.
    """
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prefix"))
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), "text"
    )
    return user.join(reply, ["conv_id", "turn"]).select(turn_key().alias("sample_id"), "prefix", "text", *also)


def instruction_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, instruction, input, output)``: every reply, under its conversation's first system turn."""
    system = table(spark, sf_dir, "conversations").filter("role = 'system'")
    system = system.groupBy("conv_id").agg(F.min_by("text", "turn").alias("instruction"))
    replies = prefix_samples(spark, sf_dir, also=("conv_id",))
    return replies.join(system, "conv_id").select(
        "sample_id", "instruction", F.col("prefix").alias("input"), F.col("text").alias("output")
    )


def plain_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text")


def teacher_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vocab(token_counts(table(spark, sf_dir, "documents")))


def student_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vocab(token_counts(table(spark, sf_dir, "conversations")))


def exam_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third vocabulary, from the whole benchmark table."""
    return ranked_vocab(token_counts(table(spark, sf_dir, "benchmark")))


def benchmark_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sub-word vocabulary: the benchmark's words and, after them, its single letters."""
    base = exam_vocab(spark, sf_dir)
    letters = base.select(F.explode(F.split("token", "")).alias("token")).filter("token <> ''").distinct()
    last = base.agg(F.max("id").alias("last")).scalar()
    extra = global_index(letters.join(base, "token", "left_anti"), ["token"])
    return base.unionByName(extra.select("token", (F.col("idx") + 1 + last).cast("int").alias("id")))


def tokenizer_vocab(vocab: DataFrame) -> DataFrame:
    return added_tokens(vocab, [STUDENT_EOS, TEACHER_EOS])


def head_vocabs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vocabularies exactly as wide as the logit vectors: ids 1..128 and 1..64."""
    tea = vocab_head(token_counts(table(spark, sf_dir, "documents")), TEA_WIDTH)
    stu = vocab_head(token_counts(table(spark, sf_dir, "conversations")), STU_WIDTH)
    return materialize(tea), materialize(stu)


def paired_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, pos, label, tea_logits, stu_logits)`` from the embeddings.

    Ten vectors are one sample. The student's vector is the following row's, the teacher's
    is the row's own with the student's after it.
    """
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 20).alias("tea_logits")
    )
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")).scalar()
    student = rows.select(
        F.pmod(F.col("vec_id") - 1, n).alias("vec_id"),
        F.col("tea_logits").alias("stu_logits"),
        F.col("label").alias("stu_label"),
    )
    return rows.join(student, "vec_id").select(
        F.floor(F.col("vec_id") / 10).alias("sample_id"),
        F.pmod("vec_id", F.lit(10)).cast("int").alias("pos"),
        "label",
        "stu_label",
        F.concat("tea_logits", "stu_logits").alias("tea_logits"),
        "stu_logits",
    )


def step_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, side, pos, token_id, logits)``: both sides, long form."""
    paired = paired_steps(spark, sf_dir)
    sides = F.array(
        F.struct(F.lit("teacher").alias("side"), F.col("label").alias("token_id"), F.col("tea_logits").alias("logits")),
        F.struct(F.lit("student").alias("side"), F.col("stu_label").alias("token_id"), F.col("stu_logits").alias("logits")),
    )
    return paired.select("sample_id", "pos", F.inline(sides)).select(
        "sample_id", "side", "pos", (F.col("token_id") + 1).alias("token_id"), "logits"
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, step, ts, sft_loss, distill_loss, unmasked_rate)`` from the events."""
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("step"),
        "ts",
        value.alias("sft_loss"),
        (value / 2).alias("distill_loss"),
        (F.pmod("user_id", F.lit(10)) / 10).alias("unmasked_rate"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, prediction, reference)``: worked answers that end in ``#### n``."""
    key = F.col("o_orderkey")
    shown = F.when(key % 5 == 0, key + 1).otherwise(key)
    work = F.lit("so it is <<1+1=2>>2\n#### ")
    return table(spark, sf_dir, "orders").select(
        key.alias("item_id"),
        F.concat(work, F.format_number(shown, 0)).alias("prediction"),
        F.concat(work, key.cast("string")).alias("reference"),
    )


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, prediction, reference)``: replies at the same turn of two conversations."""
    replies = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    reference = replies.select("conv_id", "turn", F.col("text").alias("reference"))
    prediction = replies.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("prediction"))
    return reference.join(prediction, ["conv_id", "turn"]).select(
        turn_key().alias("sample_id"), "prediction", "reference"
    )
