"""Hard negatives by exact threshold joins with falling thresholds.

An anchor's window asks for the best rows whose score lies between two bounds. A join looks
for all of them at once, in the way of L2AP: dimensions are put in order of their weight over
all rows, and of every vector only the leading ones are indexed. The trailing ones are left
out where their norm, times the anchors' norm there, stays below the threshold, because a
pair without any indexed product cannot reach it. Partial scores are added up over the
index, group of dimensions by group of dimensions; a pair is dropped once its partial score
plus the product of the norms that remain is below the threshold. What survives is scored whole.

Windows begin with a threshold above which a normal law with the rows' own moments expects a
few rows. Windows that do not fill go on with a lower one, until they are full or at their
lower bound. The thresholds decide only how much work is done: a window's answer is complete
for every score above its threshold, and it ends where nothing below can matter.

Rows and anchors meet in blocks of bounded size, every block of anchors with every block of
rows: a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import column, stored

SCALE = 256
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 1024
PART = 256  # anchors whose partial scores are in memory at a time
GROUP = 8  # dimensions added up between two prunings
EXPECTED = 4  # rows expected above the first threshold, per row wanted
GROWTH = 8  # and how much that grows with every round
ANY = 1 << 62
_NORMAL = NormalDist()


def usable(vector: Column) -> Column:
    """A vector without a null and with finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def prepare(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``(id, label, x)``: usable rows with integer components, each distinct row once."""
    kept = rows.select(column(rows, key).alias("id"), label.cast("long").alias("label"), column(rows, vector).alias("x"))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))
    return kept.withColumn("x", F.transform("x", lambda v: F.floor(v.cast("double") * SCALE).cast("long"))).distinct()


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    if not width:
        return np.zeros((len(sizes), 0), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = values
    return out


def _tail_norms(x: np.ndarray) -> np.ndarray:
    """The norm of what follows each border of groups, column by column."""
    squares = x.astype(np.float64) ** 2
    tails = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    borders = np.arange(0, x.shape[1], GROUP)
    return np.sqrt(np.concatenate((tails[:, borders], np.zeros((len(x), 1))), axis=1)) * (1 + 1e-9)


class Index:
    """The leading dimensions of a block of rows, as far as the thresholds need them."""

    def __init__(self, x: np.ndarray, exact: bool):
        kind = np.float64 if exact else object
        self.x, self.kind = x.astype(kind), kind
        self.norms = _tail_norms(x)

    def pairs(self, a: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ``(anchor, row, score)`` whose score reaches the anchor's ``least``."""
        given = a.astype(self.kind)
        norms, weakest = _tail_norms(a), float(least.min())
        covered = norms.max(axis=0)
        partial = np.zeros((len(a), len(self.x)), self.kind)
        bound = least.astype(np.float64)[:, None] - 0.5
        alive = norms[:, 0, None] * self.norms[:, 0] >= bound
        for g in range(self.norms.shape[1] - 1):
            held = np.flatnonzero(self.norms[:, g] * covered[g] >= weakest - 0.5)
            if not len(held) or alive.mean() < 0.125:
                break
            dims = slice(g * GROUP, (g + 1) * GROUP)
            partial[:, held] += given[:, dims] @ self.x[held, dims].T
            alive[:, held] &= partial[:, held].astype(np.float64) + norms[:, g + 1, None] * self.norms[held, g + 1] >= bound
        left, right = np.nonzero(alive)
        scores = np.empty(len(left), np.int64)
        for at in range(0, len(left), 1 << 16):
            some = slice(at, at + (1 << 16))
            scores[some] = (given[left[some]] * self.x[right[some]]).sum(axis=1)
        kept = scores >= least[left]
        return left[kept], right[kept], scores[kept]


_FOUND = "anchor_id long, anchor_row long, window int, id long, score long"


def _search(order: np.ndarray, width: int, wanted: int, same: bool, exact: bool):
    """Of one block of rows and one of windows: the best ``wanted`` of every window."""

    def meet(rows: pa.Table, windows: pa.Table) -> pa.Table:
        out = {name: [] for name in ("anchor_id", "anchor_row", "window", "id", "score")}
        if rows.num_rows and windows.num_rows:
            index = Index(_matrix(rows["x"], width)[:, order], exact)
            ids, labels = (rows[c].to_numpy() for c in ("id", "label"))
            named = {c: windows[c].to_numpy() for c in ("anchor_id", "anchor_row", "anchor_label", "window", "low", "high")}
            a = _matrix(windows["anchor"], width)[:, order]
            for at in range(0, len(a), PART):
                part = {c: v[at : at + PART] for c, v in named.items()}
                i, j, score = index.pairs(a[at : at + PART], part["low"])
                fits = ((labels[j] == part["anchor_label"][i]) == same) & (score <= part["high"][i]) & (ids[j] != part["anchor_id"][i])
                i, j, score = i[fits], j[fits], score[fits]
                by = np.lexsort((ids[j], -score, i))
                i, j, score = i[by], j[by], score[by]
                first = np.searchsorted(i, i, side="left")
                best = np.arange(len(i)) - first < wanted
                i, j, score = i[best], j[best], score[best]
                for c in ("anchor_id", "anchor_row", "window"):
                    out[c].append(part[c][i])
                out["id"].append(ids[j])
                out["score"].append(score)
        kinds = {"window": pa.int32()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds.get(c, pa.int64())) for c, v in out.items()})

    return meet


def _first_threshold(moments: tuple[np.ndarray, np.ndarray]):
    """Column function: the score above which ``expect`` of ``rows`` lie below ``high``, by a normal law."""
    mean, variance = moments

    def thresholds(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for vectors, highs, shares in batches:
            out = []
            for vector, high, share in zip(vectors, highs, shares):
                a = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                middle, spread = float(a @ mean[: len(a)]), float(np.sqrt((a * a) @ variance[: len(a)]))
                if not spread:
                    out.append(0)
                    continue
                above = 1 - _NORMAL.cdf(min((high.as_py() - middle) / spread, 30.0)) if high.as_py() < ANY else 0.0
                tail = min(0.999999, max(1e-300, above + share.as_py()))
                out.append(int(max(0.0, min(middle - spread * _NORMAL.inv_cdf(tail), float(ANY // 2)))))
            yield pa.array(out, pa.int64())

    return F.arrow_udf(thresholds, "long", F.ArrowUDFType.SCALAR_ITER)


class Corpus:
    """Prepared rows in blocks, with the bounded statistics that all searches share."""

    def __init__(self, rows: DataFrame):
        self.rows = stored(rows, "negatives-rows")
        sizes = self.rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))).alias("largest")).first()
        self.count, self.width, largest = sizes["n"], sizes["width"] or 0, sizes["largest"] or 0
        self.exact = largest * largest * max(1, self.width) < 1 << 53
        mean, variance = np.zeros(self.width), np.zeros(self.width)
        if self.count > 1 and self.width:
            filled = F.concat(F.transform("x", lambda v: v.cast("double")), F.array_repeat(F.lit(0.0), F.lit(self.width) - F.size("x")))
            vector = array_to_vector(filled)
            found = self.rows.agg(vector_to_array(Summarizer.mean(vector)).alias("m"), vector_to_array(Summarizer.variance(vector)).alias("v")).first()
            mean, variance = np.array(found["m"]), np.array(found["v"])
        self.moments = (mean, variance)
        self.order = np.argsort(-(variance + mean * mean), kind="stable")
        self.labels = stored(self.rows.groupBy("label").agg(F.count("*").alias("members")), "negatives-labels")

    def best(self, windows: DataFrame, wanted: int, same: bool) -> DataFrame:
        """The first ``wanted`` rows of every window, by falling score, then by id.

        ``windows`` is ``(anchor_id, anchor_row, anchor_label, anchor, window, floor, high,
        pool)``: scores lie from ``floor`` to ``high``; ``pool`` is how many rows are in
        question. With ``same`` the rows have the anchor's label, else another one.
        """
        spark = windows.sparkSession
        searching = _search(self.order, self.width, wanted, same, self.exact)
        blocks = max(1, -(-self.count // BLOCK_ROWS))
        open_, done, expected = windows, [], EXPECTED * wanted
        while True:
            share = F.lit(float(expected)) / F.greatest(F.col("pool"), F.lit(1)).cast("double")
            guess = _first_threshold(self.moments)("anchor", "high", share)
            low = F.when(share >= 0.5, F.col("floor")).otherwise(F.greatest(F.col("floor"), guess)) if self.width else F.col("floor")
            asked = stored(open_.withColumn("low", low.cast("long")), "negatives-windows")
            n = asked.count()
            if not n:
                break
            chunks = -(-n // BLOCK_ANCHORS)
            by_chunk = F.pmod(F.xxhash64("anchor_id", "anchor_row", "window"), F.lit(chunks)).cast("int")
            by_block = F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            left = self.rows.withColumn("block", by_block).withColumn("chunk", every(chunks))
            right = asked.withColumn("chunk", by_chunk).withColumn("block", every(blocks))
            met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(searching, _FOUND)
            ranked = Window.partitionBy("anchor_id", "anchor_row", "window").orderBy(F.desc("score"), "id")
            found = stored(met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= wanted), "negatives-found")
            full = found.groupBy("anchor_id", "anchor_row", "window").agg(F.count("*").alias("got"))
            ends = ["anchor_id", "anchor_row", "window"]
            state = stored(asked.join(full, ends, "left"), "negatives-state")
            short = (F.coalesce("got", F.lit(0)) < wanted) & (F.col("low") > F.col("floor"))
            done.append(found.join(state.where(~short).select(*ends), ends))
            open_ = state.where(short).drop("low", "got")
            expected *= GROWTH
        if not done:
            return spark.createDataFrame([], _FOUND + ", rank int")
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return stored(out, "negatives-best")


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 5, percent: int = 80,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(256 * x)`` and a score is the integer inner product with the
    anchor. Higher scores come first, then smaller ids. An anchor's positives are its first
    rows of the same label, not itself. For each of them, the negatives are the first rows of
    other labels with ``percent * positive <= 100 * negative <= 100 * positive``.

    ``label`` is an expression over ``rows`` (the column ``label`` if none is given) and
    ``is_anchor`` a condition on ``id``. Rows take no part if their id, label or vector is null
    or any component null or not finite. A shorter vector counts as filled up with zeros.
    Rows equal in id, label and vector count once; different rows of one id are anchors and
    candidates each, but never each other's. A positive below zero has no negatives, since no
    score fits its bounds, and is not looked for. Scores have to fit 64 bits. Other columns
    are not read. An empty table gives an empty table.
    """
    corpus = Corpus(prepare(rows, key, vector, column(rows, "label") if label is None else label))
    anchors = corpus.rows.where(is_anchor).select(
        F.col("id").alias("anchor_id"), F.xxhash64("label", "x").alias("anchor_row"), F.col("label").alias("anchor_label"), F.col("x").alias("anchor")
    )
    pool = anchors.join(corpus.labels, anchors["anchor_label"] == corpus.labels["label"]).drop("label")
    first = pool.select("*", F.lit(0).alias("window"), F.lit(0).cast("long").alias("floor"), F.lit(ANY).alias("high"), F.col("members").alias("pool")).drop("members")
    found = corpus.best(first, positives, same=True).select(
        "anchor_id", "anchor_row", F.col("rank").cast("int").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    each = ["anchor_id", "anchor_row"]
    floor = F.ceil(F.col("positive_score") * percent / F.lit(100)).cast("long")
    windows = anchors.join(found, each).select(
        *anchors.columns, "window", floor.alias("floor"), F.col("positive_score").alias("high"), F.lit(corpus.count).cast("long").alias("pool")
    )
    best = corpus.best(windows, negatives, same=False)
    return best.join(found, [*each, "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
