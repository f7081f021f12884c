"""The list of registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(tune(spark), sf_dir.rstrip("/"))

        tuned.__doc__ = run.__doc__
        QUERIES[run.__name__] = tuned
        if sql is not None:
            ORACLES[run.__name__] = sql.strip()
        return run

    return register


def listed(values: Column | str) -> Column:
    """An array as one comparable string."""
    column = F.col(values) if isinstance(values, str) else values
    return F.array_join(column.cast("array<string>"), ",")


# --- building blocks of the checking SQL -------------------------------------------------

BREAK = r"'[ \t\n\r\f\x0B]+'"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), {BREAK}), lambda w: w <> '')"


def vocab_sql(name: str, table: str) -> str:
    return f"""{name} AS (
      SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id
      FROM (SELECT token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS token FROM {table})
            GROUP BY token))"""


def added_sql(name: str, vocab: str) -> str:
    return f"""{name} AS (
      SELECT token, id FROM {vocab}
      UNION ALL SELECT '</s>', (SELECT max(id) FROM {vocab}) + 1
      UNION ALL SELECT '<|im_end|>', (SELECT max(id) FROM {vocab}) + 2)"""


def ids_sql(name: str, source: str, key: str, text: str, vocab: str) -> str:
    """``name(key, ids)``: the words of ``text`` looked up in ``vocab``, 0 if unknown."""
    return f"""{name}_words AS (SELECT {key}, {words_sql(text)} AS ws FROM {source}),
    {name} AS (
      SELECT w.{key}, coalesce(t.ids, []::INTEGER[]) AS ids FROM {name}_words w LEFT JOIN (
        SELECT {key}, list(coalesce(v.id, 0)::INTEGER ORDER BY pos) AS ids
        FROM (SELECT {key}, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM {name}_words) x
        LEFT JOIN {vocab} v USING (token) GROUP BY {key}) t USING ({key}))"""


def pair_sql(a: str, b: str) -> str:
    """One number for two that are not negative; different pairs get different numbers."""
    return f"((({a} + {b}) * ({a} + {b} + 1)) // 2 + {b})"


PREFIX_SAMPLES = f"""prefix_samples AS (
  SELECT {pair_sql('u.conv_id', 'u.turn')} AS sample_id, u.conv_id, u.text AS prefix, a.text AS text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

INSTRUCTION_SAMPLES = f"""{PREFIX_SAMPLES},
instruction_samples AS (
  SELECT sample_id, s.instruction, prefix AS input, text AS output
  FROM prefix_samples JOIN (
    SELECT conv_id, arg_min(text, turn) AS instruction FROM conversations WHERE role = 'system' GROUP BY conv_id) s
  USING (conv_id))"""

PAIRED_STEPS = """paired_steps AS (
  SELECT t.vec_id // 10 AS sample_id, (t.vec_id % 10)::INTEGER AS pos, t.label AS label, s.label AS stu_label,
         list_transform(t.embedding || s.embedding, lambda x: x::DOUBLE * 20) AS tea_logits,
         list_transform(s.embedding, lambda x: x::DOUBLE * 20) AS stu_logits
  FROM embeddings t JOIN embeddings s
    ON s.vec_id = (t.vec_id + 1) % (SELECT count(*) FROM embeddings))"""

STEP_LOGITS = PAIRED_STEPS + """,
step_logits AS (
  SELECT sample_id, 'teacher' AS side, pos, label + 1 AS token_id, tea_logits AS logits FROM paired_steps
  UNION ALL
  SELECT sample_id, 'student', pos, stu_label + 1, stu_logits FROM paired_steps)"""

METRICS_ROWS = """metrics AS (
  SELECT event_type AS run, event_id AS step, ts,
         CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS sft_loss,
         CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END / 2 AS distill_loss,
         (user_id % 10) / 10.0::DOUBLE AS unmasked_rate
  FROM events)"""


def softmax_sql(v: str) -> str:
    return (
        f"list_transform(list_transform({v}, lambda x: exp(x - list_max({v}))), "
        f"lambda e: e / list_sum(list_transform({v}, lambda y: exp(y - list_max({v})))))"
    )


def log_softmax_sql(v: str) -> str:
    return (
        f"list_transform({v}, lambda x: x - list_max({v}) "
        f"- ln(list_sum(list_transform({v}, lambda y: exp(y - list_max({v}))))))"
    )
