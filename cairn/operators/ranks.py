"""Leaderboards: 1-based ranks by score, ties by primary key in the same direction."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators.parts import cuts_of, with_part

#: Ranks up to which the best rows are taken without ranking all: of the whole table, and of each group (Spark's own limit for cutting groups before the shuffle).
SMALL_RANK, GROUP_LIMIT = 10_000, 1000


def _sorted(columns: list[str], order: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() if order == "desc" else F.col(c).asc_nulls_first() for c in columns]


class Leaderboard:
    """Rank queries over df. ``desc`` (the default) ranks large scores, and on ties large keys, first."""

    def __init__(self, df: DataFrame, score: str, key: list[str], group: list[str] | None = None, order: str = "desc"):
        if order not in ("asc", "desc"):
            raise ValueError(order)
        self.df, self.score, self.key, self.group, self.order = df.where(F.col(score).isNotNull()), score, key, group or [], order

    def ranked(self, parts: int = 256) -> DataFrame:
        """All rows with ``rank``.

        Rows are dealt to parts along (score, key), so that tied scores are split too; they are numbered in their part
        of their group and shifted by the counts of the parts before it, at most ``parts`` rows for a group. No task
        holds a whole group, however hot, and scores of any ordered type will do.
        """
        names = [self.score, *self.key]
        rows = with_part(self.df, names, cuts_of(self.df, names, parts), parts)
        ahead = F.col("_part").desc() if self.order == "desc" else F.col("_part").asc()
        earlier = Window.partitionBy(*self.group).orderBy(ahead).rowsBetween(Window.unboundedPreceding, -1)
        before = rows.groupBy(*self.group, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        own = [F.col(c).alias(f"_own_{k}") for k, c in enumerate([*self.group, "_part"])]
        before = before.select(*own, "_before")
        same = F.lit(True)
        for k, c in enumerate([*self.group, "_part"]):
            same = same & F.col(c).eqNullSafe(F.col(f"_own_{k}"))
        inside = F.row_number().over(Window.partitionBy(*self.group, "_part").orderBy(*_sorted(names, self.order)))
        out = rows.withColumn("_inside", inside).join(before if self.group else F.broadcast(before), same)
        return out.withColumn("rank", F.col("_inside") + F.col("_before")).select(*self.df.columns, "rank")

    def _best(self, n: int) -> DataFrame:
        """The best n rows of each group with their ranks; every task passes on at most n rows of a group."""
        if n > GROUP_LIMIT:
            return self.ranked().where(F.col("rank") <= n)
        order = Window.partitionBy(*self.group).orderBy(*_sorted([self.score, *self.key], self.order))
        return self.df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    def top(self, n: int) -> DataFrame:
        """Best n rows (of each group)."""
        if n <= 0:
            raise ValueError("n must be positive")
        if self.group:
            return self._best(n)
        return self.df.orderBy(*_sorted([self.score, *self.key], self.order)).limit(n)

    def bottom(self, n: int) -> DataFrame:
        return Leaderboard(self.df, self.score, self.key, self.group, "asc" if self.order == "desc" else "desc").top(n)

    def at(self, rank: int) -> DataFrame:
        return self.between(rank, rank)

    def between(self, first: int, last: int) -> DataFrame:
        """Rows of ranks first to last, both included."""
        if first < 1 or last < first:
            raise ValueError("ranks begin at 1")
        if not self.group and last <= SMALL_RANK:  # the best few rows alone, numbered in one task
            by = _sorted([self.score, *self.key], self.order)
            best = self.df.orderBy(*by).limit(last)
            return best.withColumn("rank", F.row_number().over(Window.orderBy(*by))).where(F.col("rank") >= first)
        return (self._best(last) if self.group else self.ranked()).where(F.col("rank").between(first, last))

    def by_score(self, low: Any, high: Any) -> DataFrame:
        return self.df.where(F.col(self.score).between(low, high)).orderBy(*_sorted([self.score, *self.key], self.order))

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.group).agg(F.count("*").alias("count")) if self.group else self.df.agg(F.count("*").alias("count"))

    def rank_of(self, score: Any, key: list[Any], at: dict[str, Any] | None = None) -> int | None:
        """Rank of a row, None if it isn't there: rows ahead of it are counted, nothing is sorted."""
        rows = self.df
        for name, value in (at or {}).items():
            rows = rows.where(F.col(name) == F.lit(value))
        own = [F.col(c) == F.lit(v) for c, v in zip([self.score, *self.key], [score, *key], strict=True)]
        better, tied = F.lit(False), F.lit(True)
        for c, v in zip([self.score, *self.key], [score, *key], strict=True):
            ahead = F.col(c) > F.lit(v) if self.order == "desc" else F.col(c) < F.lit(v)
            better, tied = better | (tied & ahead), tied & (F.col(c) == F.lit(v))
        same = own[0]
        for o in own[1:]:
            same = same & o
        row = rows.agg(F.count_if(better).alias("ahead"), F.count_if(same).alias("there")).first()
        return row.ahead + 1 if row.there else None

    def score_at(self, rank: int) -> DataFrame:
        return self.at(rank).select(*self.group, F.col(self.score))
