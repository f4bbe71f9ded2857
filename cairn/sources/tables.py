"""Parquet tables of record types: reading, writing partitioned by tenant, replacing after changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.catalog import Catalog, RecordType, Store


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def open_store(spark: SparkSession, catalog: Catalog, folder: str, name: str, tenant: dict | None = None) -> Store:
    return catalog.store(read(spark, folder, name), name, tenant)


def write(df: DataFrame, kind: RecordType, path: str, cluster_by: list[str] | None = None) -> None:
    """Write a table without transient fields, partitioned by tenant and sorted inside files, so that scans skip row groups."""
    df = df.drop(*kind.transient)
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*kind.tenant) if kind.tenant else writer).parquet(path)


def replace(store: Store, path: str, new_path: str) -> Store:
    """Write a changed store beside the old table, which stays readable, and reopen it there."""
    if path == new_path:
        raise ValueError("a table can't be replaced while it is read; write beside it and switch")
    write(store.df, store.kind, new_path)
    return Store(store.df.sparkSession.read.parquet(new_path), store.kind, store.indexes)
