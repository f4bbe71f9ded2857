"""Table and column statistics, histograms, and estimates of selectivity from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.predicates import Both, Leaf, Not, Predicate


def table_stats(df: DataFrame) -> DataFrame:
    """Rows and their mean size as text."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.avg(size).alias("mean_bytes"))


def column_stats(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each column: nulls, distinct values (approximate), least and greatest, as text; one pass."""
    parts = []
    for c in columns:
        col = F.col(c)
        parts += [F.count_if(col.isNull()).alias(f"n_{c}"), F.approx_count_distinct(c, 0.02).alias(f"d_{c}"), F.min(c).cast("string").alias(f"a_{c}"), F.max(c).cast("string").alias(f"b_{c}")]
    row = df.agg(F.count("*").alias("n"), *parts)
    out = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"n_{c}").alias("n_null"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"a_{c}").alias("low"), F.col(f"b_{c}").alias("high")) for c in columns])
    return row.select(F.inline(out))


def distinct_sketches(df: DataFrame, by: list[str], of: str) -> DataFrame:
    """A mergeable distinct-count sketch for each group (2**14 registers)."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(of, 14).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    total = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct")
    return sketches.groupBy(*by).agg(total) if by else sketches.agg(total)


def reservoir(df: DataFrame, key: list[str], n: int = 10_000, seed: int = 0) -> DataFrame:
    """n rows, each set of n as likely as any other, and the same ones on every run: those of the least hashes."""
    order = F.xxhash64(*key, F.lit(seed))
    return df.orderBy(order, *key).limit(n)


def value_histogram(df: DataFrame, of: str) -> DataFrame:
    """How often each value is met."""
    return df.where(F.col(of).isNotNull()).groupBy(of).agg(F.count("*").alias("n"))


def range_histogram(df: DataFrame, of: str, low: float, high: float, buckets: int) -> DataFrame:
    """Counts of equal-width buckets from low to high; values outside go to the nearest."""
    place = F.floor((F.col(of) - low) / (high - low) * buckets)
    bucket = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place)).cast("int")
    return df.where(F.col(of).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(of).alias("low"), F.max(of).alias("high"))


#: Shares taken where nothing is known: a bound that may lie anywhere halves the rows, as a substring may or may not be
#: there; a first letter is one of 26; equality keeps one row in 50, as columns of some dozens of values are usual to ask for.
GUESS = {"==": 0.02, "!=": 0.98, "<": 0.5, "<=": 0.5, ">": 0.5, ">=": 0.5, "prefix": 1 / 26, "contains": 0.5}


def selectivity(p: Predicate, histograms: dict[str, list[tuple[float, float, int]]] | None = None, distinct: dict[str, int] | None = None) -> float:
    """Estimated share of rows; histograms: (low, high, count) of buckets by field, ends included."""
    if isinstance(p, Not):
        return 1 - selectivity(p.part, histograms, distinct)
    if isinstance(p, Both):
        out = 1.0
        for part in p.parts:
            s = selectivity(part, histograms, distinct)
            out *= s if p.how == "and" else 1 - s
        return out if p.how == "and" else 1 - out
    if not isinstance(p, Leaf):
        return 0.5
    one = 1 / distinct[p.name] if distinct and p.name in distinct else GUESS["=="]
    if p.op == "in":
        return min(1.0, len(p.value) * one)
    buckets = (histograms or {}).get(p.name)
    if not buckets or p.op in ("prefix", "contains"):
        return one if p.op == "==" else 1 - one if p.op == "!=" else GUESS[p.op]
    total, value = sum(n for *_, n in buckets), float(p.value)
    if p.op in ("==", "!="):
        inside = sum(n for a, b, n in buckets if a <= value <= b)
        share = min(1.0, inside / total if inside == 0 else max(one, inside / total * one))
        return share if p.op == "==" else 1 - share
    below = sum(n if b < value else n * (value - a) / (b - a) if a < value and b > a else 0 for a, b, n in buckets) / total
    return below if p.op in ("<", "<=") else 1 - below


def range_stats(df: DataFrame, lower: str, upper: str) -> DataFrame:
    """Rows, mean width and span of ranges, and the mean number of ranges over a point of the span."""
    width = F.col(upper) - F.col(lower)
    out = df.where(width.isNotNull()).agg(F.count("*").alias("n"), F.avg(width).alias("mean_width"), F.sum(width).alias("total"), F.min(lower).alias("low"), F.max(upper).alias("high"))
    return out.select("n", "mean_width", "low", "high", F.try_divide(F.col("total"), F.col("high") - F.col("low")).alias("overlap_factor"))
