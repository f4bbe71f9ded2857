"""Grouped and maintained aggregates."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Aggregate:
    """A named aggregate: count(), sum_("x"), avg("x"), min_("x"), max_("x"), or any aggregate Column."""

    def __init__(self, kind: str, of: str | None, column: Column, alias: str):
        self.kind, self.of, self.expression, self.alias = kind, of, column, alias

    def named(self, alias: str) -> Aggregate:
        return Aggregate(self.kind, self.of, self.expression, alias)

    def column(self) -> Column:
        return self.expression.alias(self.alias)


def count() -> Aggregate:
    return Aggregate("count", None, F.count(F.lit(1)), "count")


def sum_(of: str) -> Aggregate:
    return Aggregate("sum", of, F.sum(of), f"sum_{of}")


def avg(of: str) -> Aggregate:
    return Aggregate("avg", of, F.avg(of), f"avg_{of}")


def min_(of: str) -> Aggregate:
    return Aggregate("min", of, F.min(of), f"min_{of}")


def max_(of: str) -> Aggregate:
    return Aggregate("max", of, F.max(of), f"max_{of}")


def stddev(of: str) -> Aggregate:
    return Aggregate("stddev", of, F.stddev_samp(of), f"stddev_{of}")


def percentile(of: str, share: float) -> Aggregate:
    """Exact percentile, between values by straight lines."""
    return Aggregate("percentile", of, F.percentile(of, F.lit(share)), f"percentile_{of}")


def distinct(of: str) -> Aggregate:
    return Aggregate("distinct", of, F.countDistinct(of), f"distinct_{of}")


def custom(alias: str, column: Column) -> Aggregate:
    return Aggregate("custom", None, column, alias)


class Grouped:
    """df.groupBy with HAVING and a result transform; partial sums run before the shuffle."""

    def __init__(self, df: DataFrame, by: list[str], aggregates: list[Aggregate] | None = None, having: list[Callable[[DataFrame], Column]] | None = None, sets: list[list[str]] | None = None):
        self.df, self.by, self.aggregates, self.conditions, self.sets = df, by, aggregates or [], having or [], sets

    def agg(self, *aggregates: Aggregate) -> Grouped:
        return Grouped(self.df, self.by, [*self.aggregates, *aggregates], self.conditions, self.sets)

    def having(self, condition: Callable[[DataFrame], Column]) -> Grouped:
        return Grouped(self.df, self.by, self.aggregates, [*self.conditions, condition], self.sets)

    def grouping_sets(self, *sets: list[str]) -> Grouped:
        """Groups by each of several lists of the fields; others are null, and ``level`` tells which (a bit for each field left out, the first the highest)."""
        return Grouped(self.df, self.by, self.aggregates, self.conditions, list(sets))

    def rollup(self) -> Grouped:
        return self.grouping_sets(*[self.by[:n] for n in range(len(self.by), -1, -1)])

    def cube(self) -> Grouped:
        return self.grouping_sets(*[[f for k, f in enumerate(self.by) if n >> k & 1] for n in range(1 << len(self.by))])

    def to_df(self, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        columns = [a.column() for a in self.aggregates]
        if self.sets is None:
            out = self.df.groupBy(*self.by).agg(*columns)
        else:
            out = self.df.groupingSets([[F.col(f) for f in s] for s in self.sets], *self.by).agg(*columns, F.grouping_id(*self.by).alias("level"))
        for condition in self.conditions:
            out = out.where(condition(out))
        return transform(out) if transform else out


#: What a group without rows has.
EMPTY = {"count": 0, "sum": 0, "avg": None}


def lookup(df: DataFrame, aggregate: Aggregate, at: dict[str, Any] | None = None) -> Any:
    """Value of one group, or of all rows: 0 for COUNT and SUM of none, None for AVG; MIN and MAX of none raise."""
    for name, value in (at or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    row = df.agg(F.count(F.lit(1)).alias("_n"), aggregate.column()).first()
    if row[1] is None:
        if aggregate.kind in ("min", "max"):
            raise LookupError(f"no rows for {aggregate.alias}")
        return EMPTY.get(aggregate.kind)
    return row[1]


def maintained(df: DataFrame, by: list[str], of: str | None = None) -> DataFrame:
    """The table that maintained COUNT, SUM, MIN, MAX and AVG read: one row a group, with sum and count kept apart."""
    out = [F.count(F.lit(1)).alias("n")]
    if of:
        out += [F.sum(of).alias("total"), F.count(of).alias("n_values"), F.min(of).alias("low"), F.max(of).alias("high")]
    return df.groupBy(*by).agg(*out)


def merged(table: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """A maintained table after more rows of the same form were added."""
    how = {"n": F.sum, "total": F.sum, "n_values": F.sum, "low": F.min, "high": F.max}
    return table.unionByName(more).groupBy(*by).agg(*[how[c](c).alias(c) for c in table.columns if c not in by])


def retracted(table: DataFrame, less: DataFrame, by: list[str]) -> DataFrame:
    """Counts and sums after rows were deleted; groups that are empty go. MIN and MAX need a rebuild of the groups met."""
    minus = less.select(*by, (-F.col("n")).alias("n"), *[(-F.col(c)).alias(c) for c in ("total", "n_values") if c in less.columns])
    keep = [c for c in ("n", "total", "n_values") if c in table.columns]
    return table.select(*by, *keep).unionByName(minus).groupBy(*by).agg(*[F.sum(c).alias(c) for c in keep]).where("n > 0")


def divided(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
