"""Linear scores and softmax over array columns.

Everything stays in the row: no row is exploded into features or classes, so
scoring is a map over the input and needs no shuffle whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_array(values: Sequence[float]) -> str:
    """An array of doubles as SQL text: one expression, however many numbers."""
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def linear_logits(
    features: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None
) -> Column:
    """One logit per class, as an array in class order; added up in element order."""
    matrix = F.expr(f"array({', '.join(constant_array(w) for w in weights)})")
    start = F.expr(constant_array(bias or [0.0] * len(weights)))

    def logit(w: Column, b: Column) -> Column:
        products = F.zip_with(features, w, lambda x, y: x.cast("double") * y)
        return F.aggregate(products, b, lambda acc, x: acc + x)

    return F.zip_with(matrix, start, logit)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the largest logit is taken off first.

    Largest value and total are paired with the elements instead of being named
    inside the lambdas, where they would be computed anew for every element.
    """

    def paired(values: Column, one: Column, fn) -> Column:
        return F.zip_with(values, F.array_repeat(one, F.size(values)), fn)

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return paired(powers, total, lambda p, t: p / t)

    powers = paired(logits, F.array_max(logits), lambda x, m: F.exp(x - m))
    return F.transform(F.array(powers), shares)[0]


def argmax(values: Column) -> Column:
    """Position of the largest value from 0; among equals the lowest."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
