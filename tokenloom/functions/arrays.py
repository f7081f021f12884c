"""Expressions over arrays of numbers: one logit vector is one array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.constants import ENTROPY_EPSILON


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A lambda body is evaluated per element, so ``transform(a, x -> x - array_max(a))``
    costs a whole pass per element. Bound through a one-element array it costs one. The
    same goes for a column a lambda refers to: the optimizer may put its defining
    expression in its place.
    """
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def softmax(logits: Column) -> Column:
    return let(
        doubles(logits),
        lambda v: let(
            F.array_max(v),
            lambda top: let(
                F.transform(v, lambda x: F.exp(x - top)),
                lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)),
            ),
        ),
    )


def log_softmax(logits: Column) -> Column:
    return let(
        doubles(logits),
        lambda v: let(
            F.array_max(v),
            lambda top: let(
                top + F.log(total(F.transform(v, lambda x: F.exp(x - top)))),
                lambda norm: F.transform(v, lambda x: x - norm),
            ),
        ),
    )


def scaled(logits: Column, temperature: float) -> Column:
    return F.transform(doubles(logits), lambda x: x / F.lit(float(temperature)))


def entropy(logits: Column, epsilon: float = ENTROPY_EPSILON) -> Column:
    """-sum q ln q with q = softmax + epsilon."""
    return -F.aggregate(
        F.transform(softmax(logits), lambda p: p + F.lit(epsilon)),
        F.lit(0.0),
        lambda acc, q: acc + q * F.log(q),
    )


def argmax(values: Column, id_base: int = 0) -> Column:
    """Id of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1 + id_base).cast("int")


def gather(values: Column, token_id: Column, id_base: int = 0) -> Column:
    """The entry of ``token_id``; NULL for a NULL or out-of-range id."""
    return F.get(values, (token_id - id_base).cast("int"))


def padded(values: Column, width: Column, fill, side: str = "right") -> Column:
    filler = F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0)))
    return F.concat(filler, values) if side == "left" else F.concat(values, filler)


def rotated(values: Column, start: Column) -> Column:
    """Rotate left so that index ``start`` comes first."""
    return F.concat(
        F.slice(values, start + 1, F.size(values)),
        F.slice(values, F.lit(1), start),
    )


def top_entries(logits: Column, k: int, id_base: int = 0) -> Column:
    """The k largest as ``array<struct<rank, token_id, logit>>``; ties by id.

    Sorting happens inside the row, so nothing is exploded or shuffled.
    """
    keyed = F.transform(
        doubles(logits), lambda x, i: F.struct((-x).alias("neg"), (i + id_base).alias("id"))
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k),
        lambda e, i: F.struct(
            (i + 1).alias("rank"),
            e["id"].cast("int").alias("token_id"),
            (-e["neg"]).alias("logit"),
        ),
    )


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
