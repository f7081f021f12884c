"""The costly reductions of logit vectors, for vectors of many thousands of entries.

Lambda expressions are interpreted per entry. From about ``HOF_WIDTH`` entries on, handing
whole vectors to numpy in Arrow batches is many times faster. The results are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tokenloom.constants import ENTROPY_EPSILON

HOF_WIDTH = 1024


def _log_softmax(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, dtype=np.float64)
    v = v - v.max()
    return v - np.log(np.exp(v).sum())


def _each(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([fn(*row) for row in zip(*columns)], dtype="float64")


def entropy(logits: Column, epsilon: float = ENTROPY_EPSILON) -> Column:
    @F.pandas_udf(DoubleType())
    def run(v: pd.Series) -> pd.Series:
        def one(row) -> float:
            q = np.exp(_log_softmax(row)) + epsilon
            return float(-(q * np.log(q)).sum())

        return _each(one, v)

    return run(logits)


def forward_kl_step(teacher: Column, student: Column, temperature: float) -> Column:
    @F.pandas_udf(DoubleType())
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        def one(a, b) -> float:
            p, q = _log_softmax(np.asarray(a) / temperature), _log_softmax(np.asarray(b) / temperature)
            return float((np.exp(p) * (p - q)).sum() * temperature**2)

        return _each(one, t, s)

    return run(teacher, student)


def kl_topk_step(teacher: Column, student: Column, temperature: float) -> Column:
    """``struct<total, finite>``, as ``losses.kl_topk_step``."""

    @F.pandas_udf("total double, finite long")
    def run(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        def one(a, b) -> tuple[float, int]:
            p, q = _log_softmax(a), _log_softmax(np.asarray(b, dtype=np.float64) / temperature)
            with np.errstate(invalid="ignore"):
                terms = np.exp(p) * (p * temperature**2 - q)
            kept = terms[~np.isinf(terms)]
            return float(kept.sum()), len(kept)

        return pd.DataFrame([one(a, b) for a, b in zip(t, s)], columns=["total", "finite"])

    return run(teacher, student)


def sorted_distance(teacher: Column, student: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        def one(a, b) -> float:
            p, q = (np.sort(np.exp(_log_softmax(x)))[::-1] for x in (a, b))
            width = max(len(p), len(q))
            return float(np.abs(np.pad(p, (0, width - len(p))) - np.pad(q, (0, width - len(q)))).sum())

        return _each(one, t, s)

    return run(teacher, student)


def token_nll(logits: Column, target: Column, id_base: int = 0) -> Column:
    @F.pandas_udf(DoubleType())
    def run(v: pd.Series, ids: pd.Series) -> pd.Series:
        return _each(lambda row, i: float(-_log_softmax(row)[int(i) - id_base]), v, ids)

    return run(logits, target)
