"""Registered queries: alignment, merging and candidate matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import text
from tokenloom.functions.arrays import rounded
from tokenloom.operators import align as A
from tokenloom.operators import candidates as C
from tokenloom.operators import losses as L
from tokenloom.operators import tokenize
from tokenloom.plans import distill
from tokenloom.plans import standins as S
from tokenloom.plans.queries_vocab import alphabet_sql, bytes_sql, entropy_sql
from tokenloom.plans.registry import STEP_LOGITS, listed, log_softmax_sql, query, vocab_sql, words_sql
from tokenloom.session import materialize, materialize_by

K = 10
THRESHOLD = 0.45
TEMPERATURE = 2.0
TASK_DOCUMENTS = 512  # that a task aligns


def _sides(spark, sf_dir):
    return distill.Sides.of(*S.head_vocabs(spark, sf_dir), S.TEA_WIDTH, S.STU_WIDTH)


def _aligned(spark, sf_dir, cost="weighted", sides=None):
    steps = S.step_logits(spark, sf_dir)
    samples, aligned = distill.aligned_samples(steps, sides or _sides(spark, sf_dir), cost)
    return steps, samples, aligned


def _merged(spark, sf_dir, sides=None):
    steps, _, aligned = _aligned(spark, sf_dir, sides=sides)
    return A.merge_by_group(aligned, steps.select("sample_id", "side", "pos", "logits"))


# --- alignment ---------------------------------------------------------------------------

_HEADS = f"""{vocab_sql('tea_all', 'documents')}, {vocab_sql('stu_all', 'conversations')},
  tea_vocab AS (SELECT token, id FROM tea_all WHERE id <= {S.TEA_WIDTH}),
  stu_vocab AS (SELECT token, id FROM stu_all WHERE id <= {S.STU_WIDTH}),
  {alphabet_sql('tea_vocab', 'stu_vocab')},
  tea_bytes AS (SELECT id, token, replace({bytes_sql('token')}, '_', '') AS b FROM tea_vocab),
  stu_bytes AS (SELECT id, token, replace({bytes_sql('token')}, 'Ġ', '') AS b FROM stu_vocab)"""


def _path_sql(cost: str, weights: bool = True) -> str:
    factor = " * t.weight * s.weight" if weights else ""
    return f"""{_HEADS}, {STEP_LOGITS}, {entropy_sql()},
      tea AS (SELECT w.sample_id, w.pos, w.weight, v.token, v.b FROM weights w JOIN tea_bytes v ON v.id = w.token_id
              WHERE side = 'teacher'),
      stu AS (SELECT w.sample_id, w.pos, w.weight, v.token, v.b FROM weights w JOIN stu_bytes v ON v.id = w.token_id
              WHERE side = 'student'),
      costs AS (
        SELECT t.sample_id, list(({cost}){factor} ORDER BY t.pos, s.pos) AS c,
               count(DISTINCT t.pos) AS n, count(DISTINCT s.pos) AS m
        FROM tea t JOIN stu s USING (sample_id) GROUP BY t.sample_id),
      dp AS (
        SELECT sample_id, c, n, m, 1::BIGINT AS k, [c[1]::DOUBLE] AS d FROM costs
        UNION ALL
        SELECT sample_id, c, n, m, k + 1, list_append(d, c[k + 1] + least(
          CASE WHEN k // m > 0 THEN d[k + 1 - m] END, CASE WHEN k % m > 0 THEN d[k] END,
          CASE WHEN k // m > 0 AND k % m > 0 THEN d[k - m] END))
        FROM dp WHERE k < n * m),
      solved AS (SELECT sample_id, n, m, d FROM dp WHERE k = n * m),
      walk AS (
        SELECT sample_id, d, m, n - 1 AS i, m - 1 AS j, 0 AS back FROM solved
        UNION ALL
        SELECT sample_id, d, m, CASE WHEN move < 2 THEN i - 1 ELSE i END, CASE WHEN move <> 1 THEN j - 1 ELSE j END, back + 1
        FROM (
          SELECT *, CASE WHEN diag <= least(up, lft) THEN 0 WHEN up <= lft THEN 1 ELSE 2 END AS move FROM (
            SELECT *, CASE WHEN i > 0 AND j > 0 THEN d[(i - 1) * m + j] ELSE 'inf'::DOUBLE END AS diag,
                   CASE WHEN i > 0 THEN d[(i - 1) * m + j + 1] ELSE 'inf'::DOUBLE END AS up,
                   CASE WHEN j > 0 THEN d[i * m + j] ELSE 'inf'::DOUBLE END AS lft
            FROM walk WHERE i > 0 OR j > 0))),
      path AS (
        SELECT sample_id, (max(back) OVER (PARTITION BY sample_id) - back)::INTEGER AS ord,
               i::INTEGER AS i, j::INTEGER AS j FROM walk)"""


_WEIGHTED = _path_sql("levenshtein(t.b, s.b)")
_NORM = _path_sql("coalesce(levenshtein(t.b, s.b)::DOUBLE / nullif(length(t.b) + length(s.b), 0), 0)", weights=False)


def document_samples(docs, pieces):
    """``(sample_id, tea_tokens, stu_tokens)``: two tokenizations of every document, all of its text."""
    words = text.words(F.col("text"))
    coded = tokenize.tokenize_pieces(docs, "sample_id", {"stu": F.col("text")}, pieces, carry={"tea_tokens": words})
    read = tokenize.token_texts(F.col("stu"), pieces, distill.UNKNOWN_TOKEN)
    return coded.select("sample_id", "tea_tokens", read.alias("stu_tokens"))


@query()
def align_documents(spark, sf_dir):
    """A2, A3: whole documents, as words and as sub-words, dealt out by their cells."""
    docs, pieces = S.plain_samples(spark, sf_dir), materialize(S.benchmark_pieces(spark, sf_dir))
    # Tokens take many times the bytes of their texts, and an Arrow batch may hold all rows of a task.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // TASK_DOCUMENTS)
    dealt = A.deal(docs, parts, A.sample_cells(document_samples(docs, pieces)))
    aligned = A.align(document_samples(dealt, pieces), cost="norm")
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["i"], p["j"])), ",")
    return aligned.select(
        "sample_id", "status", F.size("tea_pos").alias("tea_steps"), F.size("stu_pos").alias("stu_steps"),
        rounded(F.col("total_cost")).alias("total_cost"), F.size("path").alias("path_steps"), F.sha2(path, 256).alias("path_sha256"),
    )


@query(f"WITH RECURSIVE {_WEIGHTED} SELECT sample_id, 'ok' AS status, round(d[n * m], 6) AS total_cost FROM solved")
def align_weighted(spark, sf_dir):
    """A1: total cost of the entropy-weighted alignment of every sample."""
    _, _, aligned = _aligned(spark, sf_dir)
    return aligned.select("sample_id", "status", rounded(F.col("total_cost")).alias("total_cost"))


@query(f"WITH RECURSIVE {_NORM} SELECT sample_id, 'ok' AS status, round(d[n * m], 6) AS total_cost FROM solved")
def align_plain(spark, sf_dir):
    """A2: total cost with length-normalised distances and no weights."""
    _, _, aligned = _aligned(spark, sf_dir, "norm")
    return aligned.select("sample_id", "status", rounded(F.col("total_cost")).alias("total_cost"))


@query(f"WITH RECURSIVE {_WEIGHTED} SELECT sample_id, ord, i, j FROM path")
def alignment_path(spark, sf_dir):
    """A3, A4: the paths."""
    return A.path_table(_aligned(spark, sf_dir)[2])


_MATCHED = f"""{_WEIGHTED},
  lists AS (SELECT sample_id, i, list(j ORDER BY j) AS members FROM path GROUP BY sample_id, i),
  groups AS (
    SELECT sample_id, members, (row_number() OVER (PARTITION BY sample_id ORDER BY first_i) - 1)::INTEGER AS step
    FROM (SELECT sample_id, members, min(i) AS first_i FROM lists GROUP BY sample_id, members))"""


@query(f"""WITH RECURSIVE {_WEIGHTED}
SELECT sample_id, 'teacher' AS side, i AS pos, string_agg(j::VARCHAR, ',' ORDER BY j) AS members FROM path GROUP BY sample_id, i
UNION ALL
SELECT sample_id, 'student', j, string_agg(i::VARCHAR, ',' ORDER BY i) FROM path GROUP BY sample_id, j""")
def match_lists(spark, sf_dir):
    """A5: partners of every position, both ways."""
    aligned = _aligned(spark, sf_dir)[2]

    def side(by, name):
        rows = A.match_lists(aligned, by)
        return rows.select("sample_id", F.lit(name).alias("side"), F.col(by).alias("pos"), listed("members").alias("members"))

    return side("i", "teacher").unionByName(side("j", "student"))


@query(f"WITH RECURSIVE {_MATCHED} SELECT sample_id, step, array_to_string(members, ',') AS members FROM groups")
def distinct_groups(spark, sf_dir):
    """The aligned steps."""
    groups = A.distinct_groups(_aligned(spark, sf_dir)[2])
    return groups.select("sample_id", "step", listed("members").alias("members"))


_MERGED = f"""{_MATCHED},
  tea_cells AS (SELECT sample_id, pos, unnest(logits) AS v, generate_subscripts(logits, 1) AS idx
                FROM step_logits WHERE side = 'teacher'),
  stu_cells AS (SELECT sample_id, pos, unnest(logits) AS v, generate_subscripts(logits, 1) AS idx
                FROM step_logits WHERE side = 'student'),
  by_student AS (
    SELECT p.sample_id, p.j, c.idx, avg(c.v) AS v FROM path p JOIN tea_cells c ON c.sample_id = p.sample_id AND c.pos = p.i
    GROUP BY p.sample_id, p.j, c.idx),
  members AS (SELECT sample_id, step, unnest(members) AS j FROM groups),
  tea_steps AS (
    SELECT m.sample_id, m.step, b.idx, avg(b.v) AS v FROM members m JOIN by_student b USING (sample_id, j)
    GROUP BY m.sample_id, m.step, b.idx),
  stu_steps AS (
    SELECT m.sample_id, m.step, c.idx, avg(c.v) AS v
    FROM members m JOIN stu_cells c ON c.sample_id = m.sample_id AND c.pos = m.j GROUP BY m.sample_id, m.step, c.idx)"""


@query(f"WITH RECURSIVE {_MERGED} SELECT sample_id, j, (idx - 1)::INTEGER AS idx, round(v, 6) AS v FROM by_student")
def merge_by_student(spark, sf_dir):
    """Teacher vectors averaged per student position."""
    steps, _, aligned = _aligned(spark, sf_dir)
    teacher = steps.filter("side = 'teacher'").select("sample_id", "pos", "logits")
    rows = A.merge_by_student(aligned, teacher).select("sample_id", "j", F.posexplode("logits").alias("idx", "v"))
    return rows.withColumn("v", rounded(F.col("v")))


@query(f"""WITH RECURSIVE {_MERGED}
SELECT sample_id, step, 'teacher' AS side, (idx - 1)::INTEGER AS idx, round(v, 6) AS v FROM tea_steps
UNION ALL SELECT sample_id, step, 'student', (idx - 1)::INTEGER, round(v, 6) FROM stu_steps""")
def merge_by_group(spark, sf_dir):
    """Both sides averaged over the aligned steps."""
    merged = _merged(spark, sf_dir)
    sides = F.array(
        F.struct(F.lit("teacher").alias("side"), F.col("tea_logits").alias("logits")),
        F.struct(F.lit("student").alias("side"), F.col("stu_logits").alias("logits")),
    )
    rows = merged.select("sample_id", "step", F.inline(sides)).select(
        "sample_id", "step", "side", F.posexplode("logits").alias("idx", "v")
    )
    return rows.withColumn("v", rounded(F.col("v")))


@query(f"""WITH RECURSIVE {_WEIGHTED}
SELECT p.sample_id, p.j, string_agg(t.token, '' ORDER BY p.i) AS text
FROM path p JOIN tea t ON t.sample_id = p.sample_id AND t.pos = p.i GROUP BY p.sample_id, p.j""")
def merged_token_text(spark, sf_dir):
    """Teacher tokens joined per student position."""
    _, samples, aligned = _aligned(spark, sf_dir)
    return A.merged_token_text(samples, aligned)


@query(f"""WITH samples AS (
  SELECT conv_id AS sample_id, coalesce(len(arg_min({words_sql('text')}, turn) FILTER (role = 'system')), 0) AS student,
         coalesce(len(arg_min({words_sql('text')}, turn) FILTER (role = 'assistant')), 0) AS teacher
  FROM conversations GROUP BY conv_id)
SELECT sample_id, student, teacher,
       CASE WHEN student = 0 THEN 'empty_student' WHEN teacher = 0 THEN 'empty_teacher' ELSE 'ok' END AS status,
       CASE WHEN student = 0 OR teacher = 0 THEN 0 ELSE -1 END AS path_steps
FROM samples""")
def align_status(spark, sf_dir):
    """A10: first turns of conversations aligned by role; conversations without one have a status and no path."""

    def tokens(role):
        own = F.col("role") == role
        first = F.min_by(F.when(own, text.words(F.col("text"))), F.when(own, F.col("turn")))
        return F.coalesce(first, F.array().cast("array<string>"))

    turns = S.table(spark, sf_dir, "conversations")
    samples = turns.groupBy(F.col("conv_id").alias("sample_id")).agg(
        tokens("system").alias("stu_tokens"), tokens("assistant").alias("tea_tokens")
    )
    aligned = A.align(samples, cost="norm")
    path = F.size(F.coalesce("path", F.array().cast("array<struct<i:int,j:int>>")))
    covers = (path >= F.greatest(F.size("stu_pos"), F.size("tea_pos"))) & (path < F.size("stu_pos") + F.size("tea_pos"))
    return aligned.select(
        "sample_id", F.size("stu_pos").cast("long").alias("student"), F.size("tea_pos").cast("long").alias("teacher"),
        "status", F.when(F.col("status") != "ok", path).otherwise(F.when(covers, -1)).alias("path_steps"),
    )


# --- candidates --------------------------------------------------------------------------


def _candidates_sql() -> str:
    def top(side: str, vocab: str) -> str:
        return f"""{side}_cand AS (
          SELECT c.sample_id, c.step, c.rank::INTEGER AS rank, c.idx::INTEGER AS id, c.v, n.token, n.b FROM (
            SELECT *, row_number() OVER (PARTITION BY sample_id, step ORDER BY v DESC, idx) AS rank FROM {side}_steps) c
          JOIN {vocab} n ON n.id = c.idx WHERE rank <= {K})"""

    return f"{_MERGED}, {top('tea', 'tea_bytes')}, {top('stu', 'stu_bytes')}"


_CAND = f"""{_candidates_sql()},
  t2s AS (SELECT t.id AS src, s.id AS dst FROM tea_vocab t JOIN stu_vocab s USING (token)),
  s2t AS (SELECT dst AS src, max(src) AS dst FROM t2s GROUP BY dst)"""


def _distance(a: str, b: str) -> str:
    return f"coalesce(levenshtein({a}.b, {b}.b)::DOUBLE / nullif(length({a}.b) + length({b}.b), 0), 0)"


def _direction_sql(name: str, src: str, targets: str, table: str) -> str:
    return f"""{name}_near AS (
      SELECT a.sample_id, a.step, a.rank, a.id AS src_id, min(({_distance('a', 'p')}, p.id))[2] AS dst_id,
             min({_distance('a', 'p')}) AS distance
      FROM {src} a JOIN {targets} p ON p.sample_id = a.sample_id AND p.step = a.step
      WHERE a.id NOT IN (SELECT src FROM {table}) AND {_distance('a', 'p')} < {THRESHOLD}
      GROUP BY a.sample_id, a.step, a.rank, a.id),
    {name}_dyn AS (
      SELECT sample_id, src_id, arg_max(dst_id, (step, rank)) AS dst_id FROM {name}_near GROUP BY sample_id, src_id),
    {name} AS (
      SELECT a.sample_id, a.step, a.rank, a.id AS src_id, coalesce(m.dst, d.dst_id)::INTEGER AS dst_id
      FROM {src} a LEFT JOIN {table} m ON m.src = a.id
      LEFT JOIN {name}_dyn d ON d.sample_id = a.sample_id AND d.src_id = a.id)"""


_STU_POOL = f"stu_pool AS (SELECT * FROM stu_cand WHERE id NOT BETWEEN 1 AND {S.TEA_WIDTH} OR id IN (SELECT src FROM t2s))"
_FORWARD = f"{_CAND}, {_STU_POOL}, {_direction_sql('fwd', 'tea_cand', 'stu_pool', 't2s')}"
_TEA_POOL = f"""tea_pool AS (
  SELECT c.* FROM tea_cand c JOIN fwd f ON f.sample_id = c.sample_id AND f.step = c.step AND f.rank = c.rank
  WHERE f.dst_id IS NOT NULL AND (c.id NOT BETWEEN 1 AND {S.STU_WIDTH + distill.SPARE_IDS} OR c.id IN (SELECT src FROM s2t)))"""
_BOTH = f"""{_FORWARD}, {_TEA_POOL}, {_direction_sql('bwd', 'stu_cand', 'tea_pool', 's2t')},
  pairs AS (SELECT *, 't2s' AS direction FROM fwd UNION ALL SELECT *, 's2t' FROM bwd)"""
_CLEAN = f"""{_CAND}, {_direction_sql('fwd', 'tea_cand', 'stu_cand', 't2s')},
  {_direction_sql('bwd', 'stu_cand', 'tea_cand', 's2t')},
  pairs AS (SELECT *, 't2s' AS direction FROM fwd UNION ALL SELECT *, 's2t' FROM bwd)"""


def _step_candidates(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    return sides, *distill.step_candidates(_merged(spark, sf_dir, sides), sides, K)


def _pairs(spark, sf_dir, mode="published"):
    sides = _sides(spark, sf_dir)
    merged = materialize_by(_merged(spark, sf_dir, sides), "sample_id")
    return sides, merged, distill.matched_pairs(merged, sides, K, THRESHOLD, mode, mode)


@query(f"""WITH RECURSIVE {_candidates_sql()}
SELECT sample_id, step, 'teacher' AS side, rank, id AS token_id, token, round(v, 6) AS logit FROM tea_cand
UNION ALL SELECT sample_id, step, 'student', rank, id, token, round(v, 6) FROM stu_cand""")
def topk_decode(spark, sf_dir):
    """M1, M2: top-K of both sides, decoded."""
    _, teacher, student = _step_candidates(spark, sf_dir)
    both = teacher.withColumn("side", F.lit("teacher")).unionByName(student.withColumn("side", F.lit("student")))
    return both.select("sample_id", "step", "side", "rank", "token_id", "token", rounded(F.col("logit")).alias("logit"))


@query(f"""WITH RECURSIVE {_CAND}
SELECT sample_id, step, rank, id AS token_id, token FROM tea_cand WHERE id NOT IN (SELECT src FROM t2s)""")
def unmapped_candidates(spark, sf_dir):
    """M3: teacher candidates the static map does not know."""
    sides, teacher, _ = _step_candidates(spark, sf_dir)
    rows = C.unmapped_candidates(teacher, sides.mapping)
    return rows.select("sample_id", "step", "rank", "token_id", "token")


@query(f"""WITH RECURSIVE {_CAND}, {_STU_POOL}
SELECT sample_id, step, rank, id AS token_id, 'published' AS pool FROM stu_pool
UNION ALL SELECT sample_id, step, rank, id, 'clean' FROM stu_cand""")
def candidate_pool(spark, sf_dir):
    """M4: student candidates that may be chosen, in both modes."""
    sides, _, student = _step_candidates(spark, sf_dir)

    def pool(mode):
        rows = C.candidate_pool(student, sides.mapping, sides.tea_size, mode, sides.first_id)
        return rows.select("sample_id", "step", "rank", "token_id", F.lit(mode).alias("pool"))

    return pool("published").unionByName(pool("clean"))


@query(f"""WITH RECURSIVE {_FORWARD}
SELECT sample_id, step, rank, src_id, dst_id, round(distance, 6) AS distance FROM fwd_near""")
def nearest_candidate(spark, sf_dir):
    """M5: the nearest allowed candidate of the same step."""
    sides, teacher, student = _step_candidates(spark, sf_dir)
    pool = C.candidate_pool(student, sides.mapping, sides.tea_size, "published", sides.first_id)
    near = C.nearest_candidate(C.unmapped_candidates(teacher, sides.mapping), pool, THRESHOLD)
    return near.withColumn("distance", rounded(F.col("distance")))


def _proposals(spark, sf_dir):
    sides, teacher, student = _step_candidates(spark, sf_dir)
    pool = C.candidate_pool(student, sides.mapping, sides.tea_size, "published", sides.first_id)
    return C.nearest_candidate(C.unmapped_candidates(teacher, sides.mapping), pool, THRESHOLD)


@query(f"WITH RECURSIVE {_FORWARD} SELECT sample_id, src_id, dst_id FROM fwd_dyn")
def dynamic_map_last(spark, sf_dir):
    """The last proposal of a sample wins."""
    return C.dynamic_map_last(_proposals(spark, sf_dir))


@query(f"""WITH RECURSIVE {_FORWARD}
SELECT src_id, arg_min(dst_id, (sample_id, step, rank)) AS dst_id, min(sample_id) AS since FROM fwd_near GROUP BY src_id""")
def dynamic_map_first(spark, sf_dir):
    """The first proposal of the run wins and stays."""
    rows = _proposals(spark, sf_dir).withColumn("batch", F.col("sample_id"))
    return C.dynamic_map_first(rows)


@query(f"""WITH RECURSIVE {_CAND}, near AS (
  SELECT a.sample_id, a.step, a.rank, min(({_distance('a', 'p')}, p.id))[2] AS dst_id
  FROM tea_cand a JOIN stu_cand p ON p.sample_id = a.sample_id AND p.step = a.step
  WHERE {_distance('a', 'p')} < {THRESHOLD} GROUP BY a.sample_id, a.step, a.rank)
SELECT a.sample_id, a.step, a.rank, a.id AS src_id, coalesce(m.dst, n.dst_id)::INTEGER AS dst_id
FROM tea_cand a LEFT JOIN t2s m ON m.src = a.id
LEFT JOIN near n ON n.sample_id = a.sample_id AND n.step = a.step AND n.rank = a.rank""")
def match_per_step(spark, sf_dir):
    """Per occurrence, without carry-over."""
    sides, teacher, student = _step_candidates(spark, sf_dir)
    return C.match_per_step(teacher, student, sides.mapping, threshold=THRESHOLD, strip="marker", pairs=A.SPECIAL_PAIRS_SORTED)


@query(f"""WITH RECURSIVE {_BOTH}
SELECT sample_id, step, direction, rank, CASE WHEN dst_id IS NULL THEN 0 ELSE src_id END AS src_id,
       coalesce(dst_id, 0) AS dst_id, dst_id IS NULL AS masked FROM pairs""")
def convert_and_mask(spark, sf_dir):
    """Pairs of both directions in the published id form."""
    return C.convert_and_mask(_pairs(spark, sf_dir)[2])


_GATHERED = """gathered AS (
  SELECT p.*,
    CASE WHEN p.dst_id IS NULL THEN -10000.0::DOUBLE ELSE t.v END AS tea_logit,
    CASE WHEN p.dst_id IS NULL THEN -10000.0::DOUBLE ELSE s.v END AS stu_logit
  FROM pairs p
  LEFT JOIN tea_steps t ON t.sample_id = p.sample_id AND t.step = p.step
    AND t.idx = CASE WHEN direction = 't2s' THEN p.src_id ELSE p.dst_id END
  LEFT JOIN stu_steps s ON s.sample_id = p.sample_id AND s.step = p.step
    AND s.idx = CASE WHEN direction = 't2s' THEN p.dst_id ELSE p.src_id END)"""


def _gather_result(spark, sf_dir, mode):
    sides, merged, pairs = _pairs(spark, sf_dir, mode)
    rows = C.gather_logits(pairs, merged, id_base=sides.first_id)
    return rows.select("sample_id", "step", F.inline("pairs")).withColumns(
        {"tea_logit": rounded(F.col("tea_logit")), "stu_logit": rounded(F.col("stu_logit"))}
    )


_GATHER_SELECT = """SELECT sample_id, step, direction, rank, src_id, dst_id,
  round(tea_logit, 6) AS tea_logit, round(stu_logit, 6) AS stu_logit FROM gathered"""


@query(f"WITH RECURSIVE {_BOTH}, {_GATHERED} {_GATHER_SELECT}")
def gather_logits(spark, sf_dir):
    """M8: logits of every pair, masked where nothing matched."""
    return _gather_result(spark, sf_dir, "published")


@query(f"WITH RECURSIVE {_CLEAN}, {_GATHERED} {_GATHER_SELECT}")
def gather_logits_clean(spark, sf_dir):
    """M4, M8, M10 in clean mode: whole pools, own markers."""
    return _gather_result(spark, sf_dir, "clean")


@query(f"""WITH RECURSIVE {_BOTH}, rates AS (
  SELECT sample_id, direction, 1 - avg((dst_id IS NULL)::INTEGER) AS rate FROM pairs GROUP BY sample_id, direction)
SELECT sample_id, round(avg(rate), 6) AS unmasked_rate FROM rates GROUP BY sample_id""")
def unmasked_rate(spark, sf_dir):
    """M9: the matched share per sample."""
    rates = C.unmasked_rate(_pairs(spark, sf_dir)[2])
    return rates.withColumn("unmasked_rate", rounded(F.col("unmasked_rate")))


@query(f"""WITH RECURSIVE {_BOTH}, rates AS (
  SELECT sample_id, direction, 1 - avg((dst_id IS NULL)::INTEGER) AS rate FROM pairs GROUP BY sample_id, direction),
each AS (SELECT sample_id, avg(rate) AS rate FROM rates GROUP BY sample_id)
SELECT sample_id // 4 AS batch, round(avg(rate), 6) AS unmasked_rate FROM each GROUP BY 1""")
def batch_rate(spark, sf_dir):
    """M9: the mean rate of every batch of four samples."""
    rates = C.unmasked_rate(_pairs(spark, sf_dir)[2])
    batches = rates.select("sample_id", F.floor(F.col("sample_id") / 4).alias("batch")).distinct()
    return distill.batch_rate(rates, batches).withColumn("unmasked_rate", rounded(F.col("unmasked_rate")))


_DENSE = f"""{_CAND}, dense AS (SELECT id AS src, dst FROM tea_vocab LEFT JOIN t2s ON src = id),
  remapped AS (
    SELECT t.sample_id, t.step, t.idx, t.v AS tea,
           coalesce(s.v, -10000.0::DOUBLE) AS stu
    FROM tea_steps t JOIN dense d ON d.src = t.idx
    LEFT JOIN stu_steps s ON s.sample_id = t.sample_id AND s.step = t.step AND s.idx = d.dst)"""


@query(f"""WITH RECURSIVE {_DENSE}, vectors AS (
  SELECT sample_id, step, list(tea ORDER BY idx) AS p, list(stu / {TEMPERATURE} ORDER BY idx) AS q
  FROM remapped GROUP BY sample_id, step),
logs AS (SELECT sample_id, step, {log_softmax_sql('p')} AS lp, {log_softmax_sql('q')} AS lq FROM vectors),
terms AS (SELECT sample_id, unnest(lp) AS a, unnest(lq) AS b FROM logs)
SELECT sample_id, round(sum(exp(a) * (a * {TEMPERATURE ** 2} - b)) / count(*), 6) AS distill_loss FROM terms GROUP BY sample_id""")
def full_vocab_loss(spark, sf_dir):
    """Student logits brought to all teacher ids, then the divergence."""
    sides = _sides(spark, sf_dir)
    merged = _merged(spark, sf_dir, sides)
    remapped = C.full_vocab_remap(merged, sides.mapping, id_base=sides.first_id)
    return L.kl_dense(remapped, TEMPERATURE).withColumn("distill_loss", rounded(F.col("distill_loss")))


def _topk_loss_sql(halves: str) -> str:
    crossed = halves == "published"
    tea = "CASE WHEN direction = 's2t' THEN stu_logit ELSE tea_logit END" if crossed else "tea_logit"
    stu = "CASE WHEN direction = 's2t' THEN tea_logit ELSE stu_logit END" if crossed else "stu_logit"
    order = "ORDER BY direction DESC, rank"
    return f"""vectors AS (
      SELECT sample_id, step, list({tea} {order}) AS p, list(({stu}) / {TEMPERATURE} {order}) AS q
      FROM gathered GROUP BY sample_id, step),
    logs AS (SELECT sample_id, step, {log_softmax_sql('p')} AS lp, {log_softmax_sql('q')} AS lq FROM vectors),
    terms AS (SELECT sample_id, unnest(lp) AS a, unnest(lq) AS b FROM logs),
    loss AS (SELECT sample_id, sum(exp(a) * (a * {TEMPERATURE ** 2} - b)) / count(*) AS distill_loss
             FROM terms GROUP BY sample_id),
    rates AS (SELECT sample_id, direction, 1 - avg((dst_id IS NULL)::INTEGER) AS rate FROM pairs GROUP BY sample_id, direction)
    SELECT l.sample_id, 'ok' AS status, round(distill_loss, 6) AS distill_loss, round(avg(rate), 6) AS unmasked_rate
    FROM loss l JOIN rates USING (sample_id) GROUP BY l.sample_id, distill_loss"""


def _loss_result(spark, sf_dir, mode):
    rows = distill.contextual_loss(
        S.step_logits(spark, sf_dir), _sides(spark, sf_dir), K, THRESHOLD, TEMPERATURE, mode
    )
    return rows.select(
        "sample_id",
        "status",
        rounded(F.col("distill_loss")).alias("distill_loss"),
        rounded(F.col("unmasked_rate")).alias("unmasked_rate"),
    )


@query(f"WITH RECURSIVE {_BOTH}, {_GATHERED}, {_topk_loss_sql('published')}")
def contextual_loss(spark, sf_dir):
    """L1 end to end: weights, alignment, merging, matching both ways, loss and rate."""
    return _loss_result(spark, sf_dir, "published")


@query(f"WITH RECURSIVE {_CLEAN}, {_GATHERED}, {_topk_loss_sql('clean')}")
def contextual_loss_clean(spark, sf_dir):
    """The same in clean mode."""
    return _loss_result(spark, sf_dir, "clean")


_FIRST_WINS = f"""{_FORWARD},
  learnt AS (SELECT src_id, arg_min(dst_id, (sample_id, step, rank)) AS dst, min(sample_id) AS since FROM fwd_near GROUP BY src_id),
  remapped AS (
    SELECT t.sample_id, t.step, t.idx, t.v AS tea, coalesce(s.v, -10000.0::DOUBLE) AS stu
    FROM tea_steps t LEFT JOIN t2s m ON m.src = t.idx
    LEFT JOIN learnt l ON l.src_id = t.idx AND l.since <= t.sample_id
    LEFT JOIN stu_steps s ON s.sample_id = t.sample_id AND s.step = t.step AND s.idx = coalesce(m.dst, l.dst))"""


@query(f"""WITH RECURSIVE {_FIRST_WINS}, vectors AS (
  SELECT sample_id, step, list(tea ORDER BY idx) AS p, list(stu / {TEMPERATURE} ORDER BY idx) AS q
  FROM remapped GROUP BY sample_id, step),
logs AS (SELECT sample_id, step, {log_softmax_sql('p')} AS lp, {log_softmax_sql('q')} AS lq FROM vectors),
terms AS (SELECT sample_id, unnest(lp) AS a, unnest(lq) AS b FROM logs)
SELECT sample_id, 'ok' AS status, round(sum(exp(a) * (a * {TEMPERATURE ** 2} - b)) / count(*), 6) AS distill_loss FROM terms GROUP BY sample_id""")
def first_wins_loss(spark, sf_dir):
    """M6b, M11, L1 end to end: one direction, a map that grows over the run."""
    steps = S.step_logits(spark, sf_dir)
    batches = steps.select("sample_id", F.col("sample_id").alias("batch")).distinct()
    loss = distill.first_wins_loss(steps, batches, _sides(spark, sf_dir), K, THRESHOLD, TEMPERATURE)
    return loss.withColumn("distill_loss", rounded(F.col("distill_loss")))


_PER_STEP = f"""{_CAND.replace(_WEIGHTED, _NORM)}, near AS (
  SELECT a.sample_id, a.step, a.rank, min(({_distance('a', 'p')}, p.id))[2] AS dst_id
  FROM tea_cand a JOIN stu_cand p ON p.sample_id = a.sample_id AND p.step = a.step
  WHERE {_distance('a', 'p')} < {THRESHOLD} GROUP BY a.sample_id, a.step, a.rank),
  pairs AS (
    SELECT a.sample_id, a.step, a.rank, a.id AS src_id, coalesce(m.dst, n.dst_id)::INTEGER AS dst_id
    FROM tea_cand a LEFT JOIN t2s m ON m.src = a.id
    LEFT JOIN near n ON n.sample_id = a.sample_id AND n.step = a.step AND n.rank = a.rank),
  vectors AS (
    SELECT p.sample_id, p.step,
           list(CASE WHEN dst_id IS NULL THEN -100.0::DOUBLE ELSE t.v END ORDER BY rank) AS p,
           list(CASE WHEN dst_id IS NULL THEN -100.0::DOUBLE ELSE s.v END ORDER BY rank) AS q
    FROM pairs p
    LEFT JOIN tea_steps t ON t.sample_id = p.sample_id AND t.step = p.step AND t.idx = p.src_id
    LEFT JOIN stu_steps s ON s.sample_id = p.sample_id AND s.step = p.step AND s.idx = p.dst_id
    GROUP BY p.sample_id, p.step)"""


@query(f"""WITH RECURSIVE {_PER_STEP},
logs AS (SELECT sample_id, {log_softmax_sql('p')} AS lp, {log_softmax_sql('q')} AS lq FROM vectors),
terms AS (SELECT sample_id, unnest(lp) AS a, unnest(lq) AS b FROM logs)
SELECT sample_id, 'ok' AS status, round(sum(exp(a) * (a - b)) / count(*), 6) AS distill_loss,
  any_value(rate) AS unmasked_rate
FROM terms JOIN (SELECT sample_id, round(1 - avg((dst_id IS NULL)::INTEGER), 6) AS rate FROM pairs GROUP BY sample_id) USING (sample_id)
GROUP BY sample_id""")
def per_step_loss(spark, sf_dir):
    """A2, M6c, M8 end to end: plain alignment, per-step matches, masked at -100."""
    loss = distill.per_step_loss(S.step_logits(spark, sf_dir), _sides(spark, sf_dir), K, THRESHOLD)
    return loss.withColumns({c: rounded(F.col(c)) for c in ("distill_loss", "unmasked_rate")})
