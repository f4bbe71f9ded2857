"""A value that an expression uses several times, worked out once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` written out a single time.

    A column that is used twice is written out twice where a filter is merged with the
    projection below it, in the branches of a CASE, and for each element of an array whose
    lambda names it; the expression grows with every such use.
    """
    return F.transform(F.array(value), f)[0]
