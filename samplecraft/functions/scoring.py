"""Linear scores, argmax, softmax cross-entropy, correctness.

All are Catalyst higher-order-function expressions over ``ARRAY<DOUBLE>``;
nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import as_col

MAX_LITERAL_HEAD = 2_000_000  # C x D above this: operators.evaluate.score_by_blocks takes the head as a table


def _array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    """Sum of element-wise products of two numeric arrays (left fold)."""
    return _array_sum(F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")))


def usable_vector(features, dim: int) -> Column:
    """Is the vector there, of length ``dim`` and without NULL elements?"""
    x = as_col(features)
    return F.coalesce(x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda v: v.isNull()), F.lit(False))


def linear_logits(features, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """``W x + b`` for a head given as driver-side lists (C rows of D weights).

    The head is a model parameter (C x D doubles), embedded in the plan as a
    literal; its size is checked.  NULL for a vector of another length or with
    NULL elements.
    """
    n_classes = len(weights)
    if n_classes == 0 or len(bias) != n_classes:
        raise ValueError("weights and bias must have the same, non-zero number of classes")
    if n_classes * len(weights[0]) > MAX_LITERAL_HEAD:
        raise ValueError("head too large to embed in a plan: use operators.evaluate.score_by_blocks")
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    b = F.array(*[F.lit(float(v)) for v in bias])
    x = as_col(features)
    return F.when(usable_vector(x, len(weights[0])), F.transform(w, lambda row, c: dot(row, x) + F.element_at(b, c + 1)))


def argmax(logits) -> Column:
    """0-based index of the largest score; the lowest index wins ties."""
    z = as_col(logits)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def logsumexp(logits) -> Column:
    z = as_col(logits)
    m = F.array_max(z)
    return F.log(_array_sum(F.transform(z, lambda v: F.exp(v - m)))) + m


def cross_entropy(logits, label_idx) -> Column:
    """``logsumexp(z) - z[y]`` with the max subtracted for stability; NULL for an
    unknown or out-of-range label."""
    z = as_col(logits)
    # get() is 0-based and NULL outside the array, so a label outside 0..C-1 gives NULL
    # (element_at would fail the job in ANSI mode, or count negative indexes from the end)
    return logsumexp(z) - F.get(z, as_col(label_idx).cast("int"))


def is_correct(label_idx, pred_idx) -> Column:
    """NULL when the label is unknown (such rows are dropped before metrics)."""
    return as_col(label_idx) == as_col(pred_idx)
