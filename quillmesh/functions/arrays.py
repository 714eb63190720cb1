"""Array column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute `value` once and use it several times inside `body`.

    Catalyst copies an expression that is mentioned twice. As the start of a fold over
    nothing it is evaluated once and handed to the closing lambda.
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda bound, _: bound, body)


def indexes(count: Column) -> Column:
    """0 .. count-1, empty for 0 (a bare `sequence(0, -1)` counts down)."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def last(values: Column) -> Column:
    """The last element, NULL for an empty array."""
    return F.get(values, F.size(values) - 1)


def joined(values: Column) -> Column:
    """An array as one comma-separated string, for comparing results across engines."""
    return F.array_join(values.cast("array<string>"), ",")
