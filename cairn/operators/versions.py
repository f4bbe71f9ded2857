"""Version history: an append-only table of key, version (a rising long), time and record fields."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class StaleVersion(Exception):
    """The record has changed since it was read."""


def append(history: DataFrame, changes: DataFrame, version: int, time: Any) -> DataFrame:
    """history with one more version of each changed record."""
    return history.unionByName(changes.withColumn("version", F.lit(version).cast("long")).withColumn("ts", F.lit(time).cast(history.schema["ts"].dataType)))


def orderable(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that have an order, which maps and variants have not."""
    return [c for c in columns if not any(word in df.schema[c].dataType.simpleString() for word in ("map<", "variant"))]


def current(history: DataFrame, key: list[str]) -> DataFrame:
    """Latest version of each record: an aggregate, so that long histories are cut down before the shuffle. Of rows that tie the greatest by all fields stays."""
    rest = [c for c in history.columns if c not in key]
    order = F.struct("version", *orderable(history, [c for c in rest if c != "version"]))
    return history.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def versions_of(history: DataFrame, at: dict[str, Any]) -> DataFrame:
    for name, value in at.items():
        history = history.where(F.col(name) == F.lit(value))
    return history.orderBy("version")


def check_version(history: DataFrame, at: dict[str, Any], expected: int) -> None:
    """Raise unless ``expected`` is the record's latest version."""
    found = versions_of(history, at).agg(F.max("version").alias("v")).first().v
    if found != expected:
        raise StaleVersion(f"{at}: version {found}, not {expected}")


def keep_last(history: DataFrame, key: list[str], n: int) -> DataFrame:
    """The latest n versions (at least one) of each record; Spark cuts up to 1000 of them before the shuffle, so that a long history stays spread."""
    newest = Window.partitionBy(*key).orderBy(F.col("version").desc())
    return history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(1, n)).drop("_n")


def keep_since(history: DataFrame, key: list[str], cutoff: Any) -> DataFrame:
    """Versions from the cutoff on, and always the latest one: only heads older than the cutoff come from an aggregate."""
    old = current(history, key).where((F.col("ts") < F.lit(cutoff)) | F.col("ts").isNull())
    return history.where(F.col("ts") >= F.lit(cutoff)).unionByName(old)
