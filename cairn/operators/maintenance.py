"""Derived tables: building them, finding what is missing or dangling in them, gaps in a build's progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.catalog import Index, Store
from cairn.operators import aggregates


def index_table(store: Store, index: Index) -> DataFrame:
    """Rows of an index: its fields (arrays: a row for each element), covered fields and the key; or groups for aggregates."""
    if index.kind in ("count", "sum", "min", "max"):
        by = list(index.fields if index.kind == "count" else index.fields[:-1])
        return aggregates.maintained(store.df, by, None if index.kind == "count" else index.fields[-1])
    df = store.df
    for f in index.fields:
        if "." not in f and df.schema[f].dataType.typeName() == "array" and index.kind == "value":
            df = df.withColumn(f, F.explode(f))
    names = list(dict.fromkeys([*index.fields, *index.covering, *store.kind.key]))
    return df.select(*[F.col(n).alias(n.replace(".", "_")) for n in names])


def built(store: Store, index: Index, path: str) -> Index:
    """Write an index's table and make it readable; a build that was cut short is simply run again."""
    index = index.moved("write_only") if index.state == "disabled" else index
    index_table(store, index).write.mode("overwrite").parquet(path)
    return index.moved("readable")


def scrub(store: Store, index: Index, table: DataFrame) -> DataFrame:
    """Rows that the table lacks (``missing``) or has beside the store (``dangling``), with counts of repeated ones."""
    want = index_table(store, index)
    names = want.columns
    one = want.groupBy(*names).agg(F.count("*").alias("_n")).select(*names, F.col("_n"))
    two = table.groupBy(*names).agg(F.count("*").alias("_n")).select(*names, (-F.col("_n")).alias("_n"))
    both = one.unionByName(two).groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return both.select(*names, F.when(F.col("_n") > 0, "missing").otherwise("dangling").alias("issue"), F.abs("_n").alias("n"))


def repaired(store: Store, index: Index, table: DataFrame) -> DataFrame:
    """The table after dangling rows went and missing ones came."""
    issues = scrub(store, index, table)
    names = [c for c in issues.columns if c not in ("issue", "n")]
    dangling, missing = issues.where("issue = 'dangling'"), issues.where("issue = 'missing'")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}")) for c in names]
    kept = table.alias("t").join(dangling.alias("d"), same, "left_anti").select(*names)
    return kept.unionByName(missing.select(*names))


def _uncovered(rows: DataFrame, *by: str) -> DataFrame:
    """Stretches of each group, from its least lower to its greatest upper bound, that no range covers."""
    order = Window.partitionBy(*by).orderBy("lower", "upper").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("upper").over(order)).where(F.col("reach") < F.col("lower")).select(*by, F.col("reach").alias("lower"), F.col("lower").alias("upper"))


def gaps(done: DataFrame, low: int, high: int, parts: int = 256) -> DataFrame:
    """Ranges from low to high (excluded) that finished ranges (lower, upper) leave out.

    The stretch is cut into parts that are searched side by side; a range counts in each part it touches, and inside
    the parts that it covers whole it is one row. Gaps that meet where parts meet, at most two for each, are joined.
    """
    if high <= low:
        return done.sparkSession.createDataFrame([], "lower long, upper long")
    width = -(-(high - low) // parts)
    n = -(-(high - low) // width)
    clipped = done.select(F.greatest(F.col("lower").cast("long"), F.lit(low)).alias("lower"), F.least(F.col("upper").cast("long"), F.lit(high)).alias("upper")).where("lower < upper")
    first, last = F.expr(f"(lower - {low}) div {width}"), F.expr(f"(upper - 1 - {low}) div {width}")
    spread = clipped.withColumn("part", F.explode(F.sequence(first, last)))
    begin = F.col("part") * width + low
    spread = spread.select("part", F.greatest("lower", begin).alias("lower"), F.least("upper", begin + width).alias("upper")).distinct()
    ends = done.sparkSession.range(n).select(F.col("id").alias("part"), F.explode(F.array(F.col("id") * width + low, F.least(F.col("id") * width + (low + width), F.lit(high)))).alias("lower"))
    pieces = _uncovered(spread.unionByName(ends.select("part", "lower", F.col("lower").alias("upper"))), "part").drop("part")
    border = (F.expr(f"(lower - {low}) % {width}") == 0) | (F.expr(f"(upper - {low}) % {width}") == 0) | (F.col("upper") == high)
    at = pieces.where(border)
    fresh = F.coalesce(F.lag("upper").over(Window.orderBy("lower")) != F.col("lower"), F.lit(True))  # at most two for each part
    at = at.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(Window.orderBy("lower").rowsBetween(Window.unboundedPreceding, 0)))
    joined = at.groupBy("run").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper")).drop("run")
    return pieces.where(~border).unionByName(joined)
