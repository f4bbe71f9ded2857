"""A fluent query that compiles to one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import ranges, spatial, vectors
from cairn.functions.predicates import Opaque, Predicate, compiled, field_type


@dataclass(frozen=True)
class Query:
    """Immutable; every method gives a new query. Rows come out as the whole record unless ``select`` is used."""

    df: DataFrame
    key: tuple[str, ...] = ()
    conditions: tuple[Predicate | Column, ...] = ()
    order: tuple[tuple[str, str], ...] = ()
    n: int | None = None
    skip: int = 0
    columns: tuple[str, ...] = ()
    windows: tuple[tuple[str, bool, Any, Any], ...] = field(default=())

    # ---- filters

    def where(self, condition: Predicate | Column) -> Query:
        return replace(self, conditions=(*self.conditions, condition))

    def overlaps(self, name: str, low: Any = None, high: Any = None, closed: bool = False, inclusive: bool = False) -> Query:
        """Rows whose range field meets [low, high). Contradictory windows on one field give no rows without a scan."""
        condition = ranges.overlaps(F.col(f"{name}.lower"), F.col(f"{name}.upper"), low, high, closed, inclusive)
        return replace(self.where(condition), windows=(*self.windows, (name, closed or inclusive, low, high)))

    def within_radius(self, lat: str, lon: str, center: tuple[float, float], meters: float) -> Query:
        return self.where(spatial.within_radius(F.col(lat), F.col(lon), center, meters))

    def within_box(self, columns: list[str], low: list[float], high: list[float]) -> Query:
        """Two or three coordinates, or latitude, longitude and altitude."""
        return self.where(spatial.within_box([F.col(c) for c in columns], low, high))

    # ---- order and size

    def order_by(self, name: str, direction: str = "asc") -> Query:
        if direction not in ("asc", "desc"):
            raise ValueError(direction)
        return replace(self, order=(*self.order, (name, direction)))

    def limit(self, n: int) -> Query:
        if n <= 0:
            raise ValueError("a limit must be positive")
        return replace(self, n=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def top_n(self, n: int, by: str) -> Query:
        """The n largest; on ties the larger key first."""
        return replace(self, order=((by, "desc"), *((k, "desc") for k in self.key))).limit(n)

    def bottom_n(self, n: int, by: str) -> Query:
        return replace(self, order=((by, "asc"), *((k, "asc") for k in self.key))).limit(n)

    def nearest(self, k: int, vector: list[float], using: str, metric: str = "l2") -> DataFrame:
        """The k nearest rows that pass the filters, with their distance: filtered first, so never fewer than there are."""
        kind = field_type(self.df.schema, using)
        if k <= 0 or not isinstance(kind, T.ArrayType):
            raise ValueError("k must be positive and the field an array")
        rows = self.filtered().where(F.size(using) == len(vector))
        return rows.withColumn("distance", vectors.distance(F.col(using), vector, metric)).orderBy("distance", *self.key).limit(k)

    def nearest_points(self, k: int, lat: str, lon: str, center: tuple[float, float]) -> DataFrame:
        rows = self.filtered().where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        return rows.withColumn("distance", spatial.haversine(F.col(lat), F.col(lon), *center)).orderBy("distance", *self.key).limit(k)

    # ---- results

    def filtered(self) -> DataFrame:
        if any(low is not None and high is not None and (low > high or low == high and not closed) for _, closed, low, high in self.windows):
            return self.df.where(F.lit(False))
        df = self.df
        for c in self.conditions:
            df = df.where(compiled(c, self.df.schema) if isinstance(c, Predicate) else c)
        return df

    def to_df(self) -> DataFrame:
        df = self.filtered()
        if self.order:
            # ties are settled by the key, so that limits are repeatable
            rest = [(k, "asc") for k in self.key if k not in {c for c, _ in self.order}]
            df = df.orderBy(*[F.col(c).asc_nulls_first() if d == "asc" else F.col(c).desc_nulls_last() for c, d in (*self.order, *rest)])
        if self.skip:
            df = df.offset(self.skip)
        if self.n is not None:
            df = df.limit(self.n)
        return df.select(*self.columns) if self.columns else df

    def first(self) -> Row | None:
        return self.limit(1).to_df().first()

    def count(self) -> int:
        return self.to_df().count()

    # ---- sets of rows by key

    def union(self, other: Query) -> DataFrame:
        return self.to_df().unionByName(other.to_df()).dropDuplicates(list(self.key))

    def intersect(self, other: Query) -> DataFrame:
        return self.to_df().join(other.to_df().select(*self.key), list(self.key), "left_semi")

    def subtract(self, other: Query) -> DataFrame:
        return self.to_df().join(other.to_df().select(*self.key), list(self.key), "left_anti")


# ---- the same as a list of clauses


@dataclass(frozen=True)
class Where:
    condition: Predicate | Column


@dataclass(frozen=True)
class OrderBy:
    name: str
    direction: str = "asc"


@dataclass(frozen=True)
class Limit:
    n: int


def from_clauses(query: Query, *clauses: Where | OrderBy | Limit | None | list) -> Query:
    """Clauses in order; None (an ``if`` that didn't hold) is skipped, lists (loops) are flattened."""
    for c in clauses:
        if isinstance(c, list):
            query = from_clauses(query, *c)
        elif isinstance(c, Where):
            query = query.where(c.condition)
        elif isinstance(c, OrderBy):
            query = query.order_by(c.name, c.direction)
        elif isinstance(c, Limit):
            query = query.limit(c.n)
        elif c is not None:
            raise TypeError(f"not a clause: {c!r}")
    return query


def matching(condition: Column, *uses: str) -> Predicate:
    """A custom predicate from a Column."""
    return Opaque(condition, frozenset(uses))
