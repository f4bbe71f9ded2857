"""Joins beyond equality: IN lists, intervals, nearest in time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators.parts import cuts_of, with_part
from cairn.operators.versions import orderable


def in_list(spark: SparkSession, df: DataFrame, name: str, values: list[Any]) -> DataFrame:
    """Rows whose field is one of the values, which the caller holds: a set tested in place, row by row, so that df is not shuffled."""
    return df.where(F.col(name).isin(*values)) if values else df.where(F.lit(False))


def interval_join(left: DataFrame, right: DataFrame, low: tuple[str, str], high: tuple[str, str], width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose half-open ranges meet; low and high name the bounds left and right, which must differ.

    Rows are put in buckets of ``width``, each in all that its range touches, and joined by bucket; a pair is kept
    in the first bucket that both touch. Choose a width near the usual length of a range.
    """
    bucketed = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    one, two = bucketed(left, low[0], high[0]), bucketed(right, low[1], high[1])
    pairs = one.join(two, [*(on or []), "_bucket"])
    first = F.floor(F.greatest(low[0], low[1]) / width)
    return pairs.where((F.col(low[0]) < F.col(high[1])) & (F.col(high[0]) > F.col(low[1])) & (F.col("_bucket") == first)).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], time: str, right_time: str, take: list[str], parts: int = 256) -> DataFrame:
    """left with ``take`` of the latest right row of its key at or before ``time``; null where there is none.

    Of right rows that tie the greatest by ``take`` counts. Null keys and times match nothing. Both sides are one table,
    dealt to parts along time; inside a key's part the last right row seen is carried on, and what the parts before it
    end with comes from at most ``parts`` rows of each key. No product of a key's rows, and no task with a whole key.
    """
    known = F.col(right_time).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    facts = right.where(known).select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*take).alias("_fact"))
    rows = left.select(*on, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(facts, allowMissingColumns=True)
    both = with_part(both, ["_t"], cuts_of(both, ["_t"], parts), parts)
    ties = [F.col(f"_fact.{c}") for c in orderable(right, take)]
    until = Window.partitionBy(*on, "_part").orderBy("_t", "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_fact", ignorenulls=True).over(until)).where("_side = 1")
    ends = both.groupBy(*on, "_part").agg(F.max_by("_fact", F.when(F.col("_side") == 0, F.struct("_t", *ties))).alias("_end"))
    earlier = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).where("_carried is not null").drop("_end")
    found = seen.join(carried, [*on, "_part"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])
