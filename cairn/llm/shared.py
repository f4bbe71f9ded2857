"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a numpy step handles at once inside a task.
STEP_BYTES = 2_000_000
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4_000_000
#: Rows of a few numbers each (about 16 to 40 bytes) up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share: spark.checkpoint.dir.

    A temporary one is set only where none is given and all runs in one process; on a cluster it must be given.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, written once and marked for broadcast if it has at most ``most`` rows; for tables of a few numbers a row."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty); other columns and their names don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from here on in this session, so that neither side of a Python worker holds more."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply make()(columns) -> columns to Arrow batches; make() runs once a task, so that it can hold caches.

    columns are lists by name; what comes back is a dict of lists or arrays for ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in by_bytes(batch):
                out = step({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

    in_small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row: texts and binaries by their lengths, other columns by their mean."""
    total = np.full(batch.num_rows, 8.0)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        else:
            total += column.nbytes / max(1, batch.num_rows)
    return total


def by_bytes(batch: pa.RecordBatch, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes each, counted row by row; a larger row is a slice of its own."""
    sums, at = np.cumsum(row_bytes(batch)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def kept_rows(df: DataFrame, make: Callable[[], Callable], column: str) -> DataFrame:
    """Rows of df for which make()(values of ``column``), a list of truth values, is true; other columns pass untouched."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in by_bytes(batch):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), type=pa.bool_()))

    in_small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


class Memo(dict):
    """A bounded cache of f(word); long words are not kept."""

    def __init__(self, f: Callable, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.f, self.most, self.longest = f, most, longest

    def __missing__(self, word):
        value = self.f(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value
