"""Maintained aggregates over streams of changes.

A change has the record's fields and ``delta``: 1 for an insert, -1 for a
delete (an update is both). Counts and sums retract; Spark keeps the groups' state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def maintained_counts(changes: DataFrame, by: list[str], of: str | None = None) -> DataFrame:
    """Count (and sum and count of values) of each group, for output mode ``complete`` or ``update``."""
    out = [F.sum("delta").alias("n")]
    if of:
        out += [F.sum(F.col("delta") * F.col(of)).alias("total"), F.sum(F.when(F.col(of).isNotNull(), F.col("delta"))).alias("n_values")]
    return changes.groupBy(*by).agg(*out)


def maintained_extremes(changes: DataFrame, by: list[str], of: str) -> DataFrame:
    """Least and greatest value of inserted records of each group."""
    return changes.where("delta > 0").groupBy(*by).agg(F.min(of).alias("low"), F.max(of).alias("high"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts by window of event time; events later than ``late`` are dropped and their windows closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run all that is there into an in-memory table."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
