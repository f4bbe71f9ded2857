"""Sharding along a Hilbert curve, with DataFrame operations only.

Several metadata dimensions are quantised to 2**bits levels each; rows are
ordered by their cell's index on the curve and cut into runs, so that a shard
covers a small box of every dimension and a reader can skip most shards by
their min/max values. Levels keep the order of the values and hold about equally
many rows: they are cut at approximate quantiles of the numbers, or of the
first bytes, beyond what all have in common, of strings.

Only a narrow table (id, size, checksum, dimensions, cell) is shuffled, never the
texts. Ranks are exact and need no global sort: rows are counted by cell, crowded
cells are split by a hash of the row, and counts of these buckets are summed up
in curve order; inside a bucket a window numbers the rows. The tables of counts
have at most 2**CELL_BITS rows plus the wanted number of buckets, whatever the
input, and are broadcast after a count.

Cases: a null text has no bytes; null dimensions count as empty strings; very
long texts count by their size alone; equal rows take neighbouring places in any
order; an empty table gives no rows; of docs only doc_id, text, source and lang
are read, whatever else is there, and rows given to shard_along_curve may have
any names but those of its results.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.bindings import once
from cairn.llm.shared import cut, small

#: Rows of a bucket in which a window numbers rows, for large inputs; at least LEAST_BUCKETS buckets.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 4096
#: Most bits of a curve index; most bytes of a string that its place is told by.
CELL_BITS, HEAD_BYTES = 20, 7


def curve_steps(n: int) -> tuple[list[int], list[int]]:
    """The curve in n dimensions as a state machine: digit and next state by state * 2**n + corner.

    A state is the entry corner and the main direction of a sub-cube; the corner
    has bit k set when dimension k lies in its upper half.
    """
    full = (1 << n) - 1
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    right = lambda x, k: left(x, n - k % n)
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(1 << n)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    entry = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    turn = lambda w: (0 if w == 0 else ones(w if w % 2 else w - 1)) % n
    states, digit, after = {(0, 0): 0}, [], []
    for start, main in (queue := [(0, 0)]):
        for corner in range(1 << n):
            w = rank[right(corner ^ start, main + 1)]
            then = (start ^ left(entry(w), main + 1), (main + turn(w) + 1) % n)
            if then not in states:
                states[then] = len(states)
                queue.append(then)
            digit.append(w)
            after.append(states[then])
    return digit, after


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the curve of a cell; each dimension is an integer from 0 to 2**bits - 1."""
    n = len(dims)
    digit, after = (F.array(*map(F.lit, x)) for x in curve_steps(n))

    def walk(place: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            corner = sum((F.call_function("getbit", place[f"d{k}"], i).cast("int") * (1 << k) for k in range(n)), F.lit(0))
            return once(acc["state"] * (1 << n) + corner, lambda at: F.struct((acc["h"] * (1 << n) + F.get(digit, at)).alias("h"), F.get(after, at).alias("state")))

        levels = F.array(*[F.lit(i) for i in reversed(range(bits))])
        return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state")), step, lambda acc: acc["h"])

    # a lambda works out again what it names: dimensions are bound before the levels are walked
    return once(F.struct(*[d.alias(f"d{k}") for k, d in enumerate(dims)]), walk)


def head_number(value: Column, skip: int) -> Column:
    """The bytes of a string after the first ``skip`` as a number that keeps their order."""
    head = F.rpad(F.hex(F.substring(value.cast("binary"), skip + 1, HEAD_BYTES)), 2 * HEAD_BYTES, "0")
    return F.conv(head, 16, 10).cast("long")


def equal_depth(rows: DataFrame, names: list[str], bits: int) -> list[Column]:
    """A level for each named column (string or number), by approximate quantiles; two aggregates over narrow rows."""
    strings = [n for n in names if rows.schema[n].dataType.typeName() == "string"]
    values = {n: F.coalesce(F.col(n), F.lit("")) if n in strings else F.col(n) for n in names}
    if strings:
        filled = {n: F.when(values[n] != "", values[n]) for n in strings}  # an empty string has nothing in common with others, and stays the lowest
        ends = rows.agg(*[f(filled[n]).alias(f"{n}_{k}") for n in strings for k, f in (("low", F.min), ("high", F.max))]).first()
        for n in strings:
            low, high = ((ends[f"{n}_{k}"] or "").encode() for k in ("low", "high"))
            values[n] = head_number(values[n], len(commonprefix([low, high])))
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = rows.agg(*[F.percentile_approx(values[n], shares).alias(n) for n in names]).first()

    def level(value: Column, cuts: list | None) -> Column:
        """How many cuts lie below a value."""
        return once(value, lambda v: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < v)).cast("long")) if cuts else F.lit(0).cast("long")

    return [level(values[n], bounds[n]) for n in names]


def shard_along_curve(rows: DataFrame, dims: list[Column], n_shards: int, law: str = "rows", bits: int = 6, size: str = "size") -> DataFrame:
    """rows plus cell, rank, shard (int) and slot (long, gapless from 0 in its shard).

    law ``rows``: counts of shards are at most one apart. ``bytes``: sums of ``size`` are near equal.
    ``rows`` should be narrow; it is written to the checkpoint folder once.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    if len(dims) * bits > CELL_BITS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits are more than {CELL_BITS} bits")
    names = rows.columns
    tie = F.xxhash64(*[F.col(c) for c in names]).bitwiseAND(F.lit((1 << 32) - 1))
    rows = cut(rows.select("*", hilbert_index(dims, bits).alias("cell"), tie.alias("_tie")))
    weight = F.col(size).cast("long")

    cells = cut(rows.groupBy("cell").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w")))
    whole = cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    wanted = max(LEAST_BUCKETS, -(-whole.n // BUCKET_ROWS))
    parts = cells.select("cell", F.ceil(F.col("_n") * wanted / max(1, whole.n)).alias("_parts"))
    rows = rows.join(small(parts), "cell").withColumn("_part", F.shiftright(F.col("_tie") * F.col("_parts"), 32))

    before = Window.orderBy("cell", "_part").rowsBetween(Window.unboundedPreceding, -1)  # over a table of bounded size
    counts = rows.groupBy("cell", "_part").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    counts = counts.select("cell", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy("cell", "_part").orderBy("_tie", *names)
    ranked = rows.join(small(counts), ["cell", "_part"]).withColumn("_all", F.lit(whole.n)).withColumn("rank", F.col("_n0") + F.row_number().over(inside) - 1)
    if law == "rows":
        ranked = ranked.withColumn("shard", F.expr(f"int(rank * {n_shards} div _all)"))
        ranked = ranked.withColumn("slot", F.expr(f"rank - (shard * _all + {n_shards - 1}) div {n_shards}"))
    else:
        middle = F.col("_w0") + F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - weight / 2
        ranked = cut(ranked.withColumn("shard", F.least(F.floor(middle * n_shards / max(1, whole.w)), F.lit(n_shards - 1)).cast("int")))
        first = ranked.groupBy("shard").agg(F.min("rank").alias("_first"))
        ranked = ranked.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("_first"))
    return ranked.select(*names, "cell", "rank", "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 40, law: str = "rows", bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, source, lang, cell, rank, shard, slot of documents, by source, language and size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
    )
    narrow = cut(narrow)
    return shard_along_curve(narrow, equal_depth(narrow, ["source", "lang", "size"], bits), n_shards, law, bits)


def shard_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """shard, rows, and low and high of each column: what a reader prunes shards by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("low", F.min), ("high", F.max))])
