"""Registered queries: losses, running metrics, task scores and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenloom.functions import arrays
from tokenloom.functions.arrays import rounded
from tokenloom.operators import labels
from tokenloom.operators import losses as L
from tokenloom.operators import scoring as W
from tokenloom.plans import standins as S
from tokenloom.plans.registry import METRICS_ROWS, PAIRED_STEPS, log_softmax_sql, pair_sql, query, softmax_sql
from tokenloom.session import scratch_path
from tokenloom.streaming import jobs

T = 2.0
ALPHA = 0.5

# The metrics have at most so many decimal digits: their sums are exact, and means are not rounded.
DIGITS = 4


def _masked_steps(spark, sf_dir):
    """Steps with an attention mask: the tail of every third sample is padding."""
    padding = (F.col("sample_id") % 3 == 0) & (F.col("pos") >= 7)
    return S.paired_steps(spark, sf_dir).withColumn("mask", F.when(padding, 0).otherwise(1))


_MASKED = PAIRED_STEPS + """, masked AS (
  SELECT *, tea_logits[1:64] AS cut, CASE WHEN sample_id % 3 = 0 AND pos >= 7 THEN 0 ELSE 1 END AS mask FROM paired_steps)"""


def _at(v: str) -> str:
    return f"list_transform({v}, lambda x: x / {T})"


def _kl_sql(p: str, q: str) -> str:
    return f"""{_MASKED},
      scaled AS (SELECT sample_id, pos, mask, {_at(p)} AS p, {_at(q)} AS q FROM masked),
      logs AS (SELECT sample_id, pos, mask, {log_softmax_sql('p')} AS lp, {log_softmax_sql('q')} AS lq FROM scaled),
      steps AS (SELECT sample_id, mask, {T * T} * list_sum(list_transform(list_zip(lp, lq), lambda e: exp(e[1]) * (e[1] - e[2]))) AS loss
                FROM logs)"""


_REDUCED = """SELECT 'token_mean' AS reduction, round(sum(loss * mask) / sum(mask), 6) AS distill_loss FROM steps
UNION ALL SELECT 'sample_mean', round(sum(loss * mask) / count(DISTINCT sample_id), 6) FROM steps"""


def _both_reductions(loss, steps):
    def one(token_mean, name):
        row = loss(steps, T, token_mean)
        return row.select(F.lit(name).alias("reduction"), rounded(F.col("distill_loss")).alias("distill_loss"))

    return one(True, "token_mean").unionByName(one(False, "sample_mean"))


@query(f"WITH {_kl_sql('cut', 'stu_logits')} {_REDUCED}")
def kl_forward(spark, sf_dir):
    """L2, L3: forward divergence over the cut teacher vocabulary, both reductions."""
    return _both_reductions(L.kl_forward, _masked_steps(spark, sf_dir))


@query(f"WITH {_kl_sql('stu_logits', 'cut')} {_REDUCED}")
def kl_reverse(spark, sf_dir):
    """L4: reverse divergence, both reductions."""
    return _both_reductions(L.kl_reverse, _masked_steps(spark, sf_dir))


@query(f"""WITH {_MASKED}
SELECT sample_id, pos, len(cut)::INTEGER AS width, round(list_sum(cut), 6) AS total FROM masked""")
def truncate_teacher_vocab(spark, sf_dir):
    """L3: teacher vectors cut to the student's width."""
    cut = L.truncate_teacher_vocab(F.col("tea_logits"), F.col("stu_logits"))
    return S.paired_steps(spark, sf_dir).select(
        "sample_id", "pos", F.size(cut).alias("width"), rounded(arrays.total(cut)).alias("total")
    )


@query(f"""WITH {_MASKED},
holed AS (SELECT cut, list_transform(stu_logits, lambda x, i: CASE WHEN (i + pos) % 11 = 0 THEN '-infinity'::DOUBLE ELSE x END) AS stu FROM masked),
logs AS (SELECT stu, {log_softmax_sql('cut')} AS lp, {log_softmax_sql('stu')} AS lq FROM holed),
terms AS (SELECT unnest(lp) AS a, unnest(lq) AS b, unnest(stu) AS x FROM logs)
SELECT round(sum(exp(a) * (a - b)) / count(*), 6) AS distill_loss FROM terms WHERE NOT isinf(x)""")
def kl_generic_infinite(spark, sf_dir):
    """L9 where some student logits are infinite: those entries are left out."""
    steps = S.paired_steps(spark, sf_dir).withColumn("tea_logits", F.slice("tea_logits", 1, S.STU_WIDTH))
    hole = lambda x, i: F.when((i + 1 + F.col("pos")) % 11 == 0, F.lit(float("-inf"))).otherwise(x)
    loss = L.kl_generic(steps.withColumn("stu_logits", F.transform("stu_logits", hole)), "mean")
    return loss.select(rounded(F.col("distill_loss")).alias("distill_loss"))


@query(f"""WITH {_MASKED},
logs AS (SELECT {log_softmax_sql('cut')} AS lp, {log_softmax_sql('stu_logits')} AS lq FROM masked),
terms AS (SELECT unnest(lp) AS a, unnest(lq) AS b FROM logs)
SELECT 'mean' AS reduction, round(sum(exp(a) * (a - b)) / count(*), 6) AS distill_loss FROM terms
UNION ALL SELECT 'sum', round(sum(exp(a) * (a - b)), 6) FROM terms""")
def kl_generic(spark, sf_dir):
    """Plain divergence, mean and sum."""
    steps = S.paired_steps(spark, sf_dir).withColumn("tea_logits", F.slice("tea_logits", 1, S.STU_WIDTH))

    def one(name):
        return L.kl_generic(steps, name).select(
            F.lit(name).alias("reduction"), rounded(F.col("distill_loss")).alias("distill_loss")
        )

    return one("mean").unionByName(one("sum"))


_ROTATED = PAIRED_STEPS + """,
sides AS (
  SELECT sample_id, 'teacher' AS side, pos, CASE WHEN pos < sample_id % 3 THEN -100 ELSE label END AS label, tea_logits AS logits
  FROM paired_steps
  UNION ALL
  SELECT sample_id, 'student', pos, CASE WHEN pos < sample_id % 4 THEN -100 ELSE stu_label END, stu_logits FROM paired_steps),
rotated AS (
  SELECT *, ((pos - min(CASE WHEN label <> -100 THEN pos END) OVER w + count(*) OVER w) % count(*) OVER w)::INTEGER AS rpos
  FROM sides WINDOW w AS (PARTITION BY sample_id, side))"""


def _rotated(spark, sf_dir):
    paired = S.paired_steps(spark, sf_dir)

    def side(name, prompt, label, logits):
        masked = F.when(F.col("pos") < F.col("sample_id") % prompt, F.lit(-100)).otherwise(F.col(label))
        return paired.select(
            "sample_id", F.lit(name).alias("side"), "pos", masked.alias("label"), F.col(logits).alias("logits")
        )

    both = side("teacher", 3, "label", "tea_logits").unionByName(side("student", 4, "stu_label", "stu_logits"))
    return labels.rotated_position(both, ["sample_id", "side"])


@query(f"WITH {_ROTATED} SELECT sample_id, side, pos, label, rpos FROM rotated")
def rotated_positions(spark, sf_dir):
    """T17 on step tables: positions counted from the start of the response."""
    return _rotated(spark, sf_dir).select("sample_id", "side", "pos", "label", "rpos")


@query(f"""WITH {_ROTATED},
sorted AS (SELECT sample_id, side, rpos, list_reverse_sort({softmax_sql('logits')}) AS p FROM rotated WHERE label <> -100),
gaps AS (
  SELECT t.sample_id, t.rpos, list_sum(list_transform(list_zip(t.p, s.p), lambda e: abs(coalesce(e[1], 0) - coalesce(e[2], 0)))) AS gap
  FROM sorted t JOIN sorted s ON s.sample_id = t.sample_id AND s.rpos = t.rpos
  WHERE t.side = 'teacher' AND s.side = 'student')
SELECT sample_id, round(avg(gap), 6) AS distill_loss FROM gaps GROUP BY sample_id""")
def sorted_probability_loss(spark, sf_dir):
    """Distance of sorted probabilities over the common response steps."""
    rows = _rotated(spark, sf_dir)
    loss = L.sorted_probability_loss(rows.filter("side = 'teacher'"), rows.filter("side = 'student'"))
    return loss.withColumn("distill_loss", rounded(F.col("distill_loss")))


@query(f"""WITH {_ROTATED},
sorted AS (SELECT sample_id, side, rpos, list_reverse_sort({softmax_sql('logits')}) AS p FROM rotated WHERE label <> -100),
gaps AS (
  SELECT t.sample_id // 8 AS batch, list_sum(list_transform(list_zip(t.p, s.p), lambda e: abs(coalesce(e[1], 0) - coalesce(e[2], 0)))) AS gap
  FROM sorted t JOIN sorted s ON s.sample_id = t.sample_id AND s.rpos = t.rpos
  WHERE t.side = 'teacher' AND s.side = 'student')
SELECT batch, round(avg(gap), 6) AS distill_loss FROM gaps GROUP BY batch""")
def sorted_probability_pooled(spark, sf_dir):
    """L5 with the positions of a batch pooled, eight samples a batch."""
    rows = _rotated(spark, sf_dir)
    batches = rows.select("sample_id", F.floor(F.col("sample_id") / 8).alias("batch")).distinct()
    sides = [rows.filter(F.col("side") == side) for side in ("teacher", "student")]
    loss = L.sorted_probability_loss(*sides, batches=batches)
    return loss.withColumn("distill_loss", rounded(F.col("distill_loss")))


@query(f"""WITH {PAIRED_STEPS}
SELECT sample_id, round(avg(-({log_softmax_sql('stu_logits')})[label + 1]), 6) AS sft_loss
FROM paired_steps GROUP BY sample_id""")
def cross_entropy(spark, sf_dir):
    """Mean negative log-likelihood of the target."""
    loss = L.cross_entropy(S.paired_steps(spark, sf_dir), "stu_logits", "label")
    return loss.withColumn("sft_loss", rounded(F.col("sft_loss")))


@query(f"""WITH {METRICS_ROWS}
SELECT run, step, round({ALPHA} * sft_loss + {1 - ALPHA} * distill_loss, 6) AS loss FROM metrics""")
def blended_loss(spark, sf_dir):
    """Both losses blended."""
    rows = S.metrics(spark, sf_dir)
    loss = L.blend(F.col("sft_loss"), F.col("distill_loss"), ALPHA)
    return rows.select("run", "step", rounded(loss).alias("loss"))


@query(f"WITH {METRICS_ROWS} SELECT run, step FROM metrics WHERE isnan(distill_loss)")
def nan_audit(spark, sf_dir):
    """Rows for quarantine."""
    return L.nan_audit(S.metrics(spark, sf_dir)).select("run", "step")


# --- running metrics ---------------------------------------------------------------------


def _exact_sql(value: str, over: str = "") -> str:
    """The sum as a double, added up in decimals."""
    return f"sum(({value})::DECIMAL(20, {DIGITS})) {over}::DOUBLE"


def _running_sql(partition: str) -> str:
    kept = "CASE WHEN isfinite(sft_loss) AND isfinite(distill_loss) THEN {} ELSE 0 END"
    columns = ", ".join(f"{_exact_sql(kept.format(v), 'OVER w')} / count(*) OVER w AS {v}" for v in ("sft_loss", "distill_loss", "unmasked_rate"))
    return f"""SELECT run, step, {columns} FROM metrics
    WINDOW w AS (PARTITION BY {partition} ORDER BY step ROWS UNBOUNDED PRECEDING)"""


@query(f"WITH {METRICS_ROWS} {_running_sql('run')}")
def running_mean(spark, sf_dir):
    """Cumulative means; rows that are not finite count but add nothing."""
    return W.running_mean(S.metrics(spark, sf_dir), block=4096, digits=DIGITS)


@query(f"WITH {METRICS_ROWS} {_running_sql('run, step // 100')}")
def running_mean_reset(spark, sf_dir):
    """The same, started anew every 100 steps."""
    return W.running_mean(S.metrics(spark, sf_dir), reset_every=100, digits=DIGITS)


@query(f"""WITH {METRICS_ROWS}
SELECT run, step, {_exact_sql('unmasked_rate', 'OVER w')} / count(*) OVER w AS unmasked_rate,
  CASE WHEN bool_and(isfinite(sft_loss)) OVER w
       THEN {_exact_sql('CASE WHEN isfinite(sft_loss) THEN sft_loss ELSE 0 END', 'OVER w')} / count(*) OVER w
       ELSE 'nan'::DOUBLE END AS sft_loss
FROM metrics WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def running_mean_unguarded(spark, sf_dir):
    """W1 without the guard, as the same-tokenizer baselines keep it."""
    # The loss has rows that are no number, and stays none from there on.
    return W.running_mean(S.metrics(spark, sf_dir), ("unmasked_rate", "sft_loss"), guard=False, digits=DIGITS)


@query(f"WITH {METRICS_ROWS} SELECT run, step, round(unmasked_rate, 6) AS unmasked_rate FROM metrics WHERE step % 3 = 0")
def log_every(spark, sf_dir):
    """Metrics sampled every third step."""
    return W.log_every(S.metrics(spark, sf_dir)).select("run", "step", rounded(F.col("unmasked_rate")).alias("unmasked_rate"))


_METRICS_SCHEMA = "run string, step long, ts timestamp, sft_loss double, distill_loss double, unmasked_rate double"


def _metrics_files(spark, sf_dir, order=(0, 1, 2, 3), closing=False):
    """The metrics as a stream: a file for each quarter of the steps, written in the given order.

    ``closing`` adds two rows without a step, one and two years later.
    """
    path, rows = scratch_path(spark, "metrics-in"), S.metrics(spark, sf_dir)
    steps = rows.agg(F.max("step") + 1).scalar()
    for part in order:
        quarter = F.floor(F.col("step") * len(order) / steps) == part
        rows.where(quarter).coalesce(1).write.mode("append").parquet(path)
    for year in (1, 2) if closing else ():
        end = rows.agg(F.date_add(F.max("ts"), 365 * year).cast("timestamp").alias("ts"))
        none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts") for f in rows.schema.fields]
        end.select(*none).coalesce(1).write.mode("append").parquet(path)
    reader = spark.readStream.schema(StructType.fromDDL(_METRICS_SCHEMA)).option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


@query(f"""WITH {METRICS_ROWS}
SELECT run, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS rows,
       {_exact_sql('CASE WHEN isfinite(sft_loss) THEN sft_loss ELSE 0 END')} / count(*) AS sft_loss,
       {_exact_sql('CASE WHEN isfinite(sft_loss) THEN distill_loss ELSE 0 END')} / count(*) AS distill_loss
FROM metrics GROUP BY 1, 2""")
def windowed_means_stream(spark, sf_dir):
    """Means per run and hour over a stream, drained."""
    out = scratch_path(spark, "windows")
    running = jobs.windowed_means_stream(_metrics_files(spark, sf_dir), out, scratch_path(spark, "state"), digits=DIGITS)
    running.awaitTermination()
    return jobs.latest_windows(spark.read.parquet(out))


@query(f"WITH {METRICS_ROWS} {_running_sql('run')}")
def running_mean_stream(spark, sf_dir):
    """Exact cumulative means over a stream whose files come out of order, drained."""
    out = scratch_path(spark, "running")
    metrics = _metrics_files(spark, sf_dir, order=(1, 0, 3, 2), closing=True)
    # Files are late by two quarters of the steps at most.
    rows = S.metrics(spark, sf_dir)
    half = F.floor(F.col("step") * 2 / rows.agg(F.max("step") + 1).scalar())
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = rows.groupBy(half).agg((F.max(micros) - F.min(micros)).alias("span"))
    late = spans.agg(F.coalesce(F.max("span"), F.lit(0))).first()[0] // 1_000_000 + 1
    running = jobs.running_mean_stream(metrics, out, scratch_path(spark, "state"), late=f"{late} seconds", block=512, digits=DIGITS)
    running.awaitTermination()
    return jobs.running_means(spark.read.parquet(out), digits=DIGITS)


# --- evaluation --------------------------------------------------------------------------


@query(f"""WITH {PAIRED_STEPS}
SELECT sample_id, pos, (list_position(stu_logits, list_max(stu_logits)) - 1)::INTEGER AS pred FROM paired_steps""")
def predicted_ids(spark, sf_dir):
    """The id of the largest logit."""
    return S.paired_steps(spark, sf_dir).select("sample_id", "pos", arrays.argmax(F.col("stu_logits")).alias("pred"))


_SHIFTED = PAIRED_STEPS + """,
scored AS (
  SELECT sample_id, pos, ((list_position(stu_logits, list_max(stu_logits)) - 1) % 10)::INTEGER AS pred,
         CASE WHEN pos < sample_id % 3 THEN -100 ELSE label END AS label FROM paired_steps),
shifted AS (SELECT pred, lead(label) OVER (PARTITION BY sample_id ORDER BY pos) AS nxt FROM scored),
counted AS (SELECT * FROM shifted WHERE nxt IS NOT NULL)"""


def _scored(spark, sf_dir):
    prompt = F.col("pos") < F.col("sample_id") % 3
    return S.paired_steps(spark, sf_dir).select(
        "sample_id",
        "pos",
        (arrays.argmax(F.col("stu_logits")) % 10).alias("pred"),
        F.when(prompt, F.lit(-100)).otherwise(F.col("label")).alias("label"),
    )


@query(f"""WITH {_SHIFTED}
SELECT 'all' AS denominator, sum((pred = nxt)::INTEGER)::BIGINT AS correct, count(*) AS counted,
       round(sum((pred = nxt)::INTEGER) / count(*), 6) AS accuracy FROM counted
UNION ALL SELECT 'content', sum((pred = nxt)::INTEGER)::BIGINT, sum((nxt <> -100)::INTEGER)::BIGINT,
       round(sum((pred = nxt)::INTEGER) / sum((nxt <> -100)::INTEGER), 6) FROM counted""")
def shifted_accuracy(spark, sf_dir):
    """Predictions against the next label, both denominators."""
    steps = _scored(spark, sf_dir)

    def one(name):
        row = W.shifted_accuracy(steps, name)
        return row.select(
            F.lit(name).alias("denominator"), "correct", "counted", rounded(F.col("accuracy")).alias("accuracy")
        )

    return one("all").unionByName(one("content"))


@query(f"WITH {_SHIFTED} SELECT sum((pred = nxt)::INTEGER)::BIGINT AS correct FROM counted")
def shifted_correct_count(spark, sf_dir):
    """The raw count."""
    return W.shifted_correct_count(_scored(spark, sf_dir))


@query(f"""WITH {PAIRED_STEPS}, nll AS (
  SELECT sample_id, avg(-({log_softmax_sql('list_transform(stu_logits, lambda z: z / 10)')})[label + 1]) AS nll
  FROM paired_steps GROUP BY sample_id)
SELECT sample_id, round(exp(nll), 6) AS perplexity FROM nll""")
def perplexity(spark, sf_dir):
    """Exp of the mean loss."""
    steps = S.paired_steps(spark, sf_dir).withColumn("stu_logits", arrays.scaled(F.col("stu_logits"), 10.0))
    loss = L.cross_entropy(steps, "stu_logits", "label")
    return loss.select("sample_id", rounded(W.perplexity(F.col("sft_loss"))).alias("perplexity"))


_ROUGE_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""WITH RECURSIVE pairs AS (
  SELECT {pair_sql('a.conv_id', 'a.turn')} AS sample_id, {_ROUGE_WORDS.format('p.text')} AS p, {_ROUGE_WORDS.format('a.text')} AS r
  FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id + 1 AND p.turn = a.turn
  WHERE a.role = 'assistant' AND p.role = 'assistant'),
rows AS (
  SELECT sample_id, 0::BIGINT AS i, list_resize([0], len(p) + 1, 0) AS best, p, r FROM pairs
  UNION ALL
  SELECT sample_id, i + 1,
    list_reduce(
      list_transform(p, lambda y, k: [CASE WHEN y = r[i + 1] THEN best[k] + 1 ELSE best[k + 1] END]),
      lambda grown, own: list_append(grown, greatest(grown[-1], own[1])), [0]), p, r
  FROM rows WHERE i < len(r)),
lcs AS (SELECT sample_id, len(p) AS np, len(r) AS nr, coalesce(best[-1], 0)::DOUBLE AS n FROM rows WHERE i = len(r)),
scored AS (SELECT sample_id, coalesce(n / nullif(np, 0), 0) AS precision, coalesce(n / nullif(nr, 0), 0) AS recall FROM lcs)
SELECT sample_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS rouge_l FROM scored""")
def rouge_l(spark, sf_dir):
    """Longest common subsequence score of whole replies."""
    rows = W.rouge_l(S.reply_pairs(spark, sf_dir))
    return rows.select(
        "sample_id", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "rouge_l")]
    )


_ANSWERS = """answers AS (
  SELECT o_orderkey AS item_id,
         'so it is <<1+1=2>>2' || chr(10) || '#### '
           || format('{:,}', CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) AS prediction,
         'so it is <<1+1=2>>2' || chr(10) || '#### ' || o_orderkey AS reference FROM orders),
graded AS (
  SELECT item_id, replace(regexp_extract(prediction, '####\\s*(-?[0-9.,]+)', 1), ',', '') AS answer,
         replace(regexp_extract(prediction, '####\\s*(-?[0-9.,]+)', 1), ',', '')
       = replace(regexp_extract(reference, '####\\s*(-?[0-9.,]+)', 1), ',', '') AS correct FROM answers)"""


@query(f"WITH {_ANSWERS} SELECT item_id, answer, correct FROM graded")
def final_answer_match(spark, sf_dir):
    """Final answers compared without thousands separators."""
    graded = W.final_answer_match(S.answers(spark, sf_dir))
    return graded.select("item_id", W.final_answer(F.col("prediction")).alias("answer"), "correct")


@query(f"""WITH {_ANSWERS}
SELECT o_orderpriority AS task, (o_custkey % 5)::INTEGER AS seed, count(*) AS items,
       round(avg(correct::INTEGER), 6) AS mean_score
FROM graded JOIN orders ON o_orderkey = item_id GROUP BY ROLLUP (o_orderpriority, o_custkey % 5)""")
def task_rollup(spark, sf_dir):
    """Mean scores per task and seed, per task and over all."""
    graded = W.final_answer_match(S.answers(spark, sf_dir)).select("item_id", "correct")
    tasks = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderpriority").alias("task"),
        (F.col("o_custkey") % 5).cast("int").alias("seed"),
    )
    scores = graded.join(tasks, "item_id").withColumn("score", F.col("correct").cast("int"))
    return W.task_rollup(scores).withColumn("mean_score", rounded(F.col("mean_score")))
