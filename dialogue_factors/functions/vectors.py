"""Row-wise vector expressions on array<double> columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

NORM_FLOOR = 1e-12


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, even if used per element."""
    return F.transform(F.array(value), use)[0]


def normalize(v: Column | str) -> Column:
    """Unit vector; the norm is floored, so a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return with_value(length, lambda n: F.transform(_col(v), lambda x: x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    floor = F.lit(NORM_FLOOR)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def argmax(v: Column | str) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(_col(v), F.array_max(_col(v))) - 1).cast("int")


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """logsumexp(logits) - logits[label], shifted by the maximum for stability.

    A label beyond the logits is an error (under the default ANSI mode), not a null.
    """
    v = _col(logits)
    log_sum = lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return with_value(F.array_max(v), log_sum) - v[_col(label)]
