"""Rows dealt to parts of about equal size along an order, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Sampled rows for each cut between parts; rows that a part has at least, more or less.
SAMPLE, ROWS = 40, 4096


def _order(columns: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])


def cuts_of(df: DataFrame, columns: list[str], parts: int) -> str:
    """Values that cut df into at most ``parts`` parts, as JSON: every SAMPLE-th of about SAMPLE * parts sampled rows.

    Rows count as often as they occur, so that a hot group is cut in proportion to its size. The cuts are fetched, at
    most ``parts`` of them, so that all uses of a part mean the same rows. Of few rows there are fewer parts.
    """
    n = df.count()
    parts = min(parts, n // ROWS)
    if parts < 2:
        return "[]"
    chosen = df.select(_order(columns).alias("c")).sample(min(1.0, SAMPLE * parts / n), 7)
    ordered = chosen.agg(F.sort_array(F.collect_list("c")).alias("all"))
    return ordered.select(F.to_json(F.filter("all", lambda c, i: (i + 1) % SAMPLE == 0))).first()[0]


def with_part(df: DataFrame, columns: list[str], cuts: str, parts: int, name: str = "_part") -> DataFrame:
    """df with the number of cuts below each row, by bisection; nulls lie below all."""
    if cuts == "[]":
        return df.withColumn(name, F.lit(0))
    kind = ArrayType(df.select(_order(columns).alias("c")).schema["c"].dataType)
    array, own = F.from_json(F.lit(cuts), kind), _order(columns)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])
    return df.withColumn(name, F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) < own, at + step).otherwise(at)))
