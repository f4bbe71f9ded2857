"""Ranges: overlap predicates and windows. A range field is a struct of lower and upper, open sides null."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(lower: Column, upper: Column, low: Any = None, high: Any = None, closed: bool = False, inclusive: bool = False) -> Column:
    """Whether [lower, upper) meets [low, high); closed: both include their ends; inclusive: high alone does.

    A missing side of the literal is open. A row without a bound that is asked for doesn't match.
    """
    tests = []
    if high is not None:
        tests.append(lower <= F.lit(high) if closed or inclusive else lower < F.lit(high))
    if low is not None:
        tests.append(upper >= F.lit(low) if closed else upper > F.lit(low))
    if not tests:
        return lower.isNotNull() & upper.isNotNull()
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def common_window(ranges: list[tuple[Any, Any]], closed: bool = False) -> tuple[Any, Any] | None:
    """Intersection of literal ranges with sides that may be None (open); None if it is empty."""
    lows, highs = [a for a, _ in ranges if a is not None], [b for _, b in ranges if b is not None]
    low, high = max(lows, default=None), min(highs, default=None)
    if low is not None and high is not None and (low > high or low == high and not closed):
        return None
    return low, high


def window_columns(ranges: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Intersection of range columns; null sides are open."""
    lows, highs = [a for a, _ in ranges], [b for _, b in ranges]
    return (lows[0] if len(lows) == 1 else F.greatest(*lows)), (highs[0] if len(highs) == 1 else F.least(*highs))
