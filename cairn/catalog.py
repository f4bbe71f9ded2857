"""Record types, indexes and stores: what a table is called, what identifies a row, which derived tables it keeps."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.predicates import field_type
from cairn.operators import aggregates
from cairn.operators.ranks import Leaderboard
from cairn.operators.versions import orderable
from cairn.plans.query import Query, from_clauses

INDEX_KINDS = ("value", "rank", "count", "sum", "min", "max", "version", "permuted", "vector", "spatial")
STATES = {"disabled": ("write_only",), "write_only": ("readable", "disabled"), "readable": ("disabled", "write_only")}


@dataclass(frozen=True)
class Index:
    """A declared index. Spark needs none to answer; it names a derived table, an order or a column to keep."""

    name: str
    kind: str
    fields: tuple[str, ...]
    covering: tuple[str, ...] = ()
    scope: str = "partition"
    state: str = "disabled"
    unique: bool = False
    options: tuple[tuple[str, Any], ...] = ()

    def __post_init__(self):
        if self.kind not in INDEX_KINDS:
            raise ValueError(f"no index kind {self.kind}")

    def moved(self, state: str) -> Index:
        """The index in another state; building goes disabled, write_only, readable."""
        if state not in STATES[self.state]:
            raise ValueError(f"{self.name}: {self.state} can't become {state}")
        return replace(self, state=state)


@dataclass(frozen=True)
class Relationship:
    """Metadata for traversal; delete rules are not enforced."""

    name: str
    to: str
    on: tuple[tuple[str, str], ...]
    delete_rule: str = "nullify"


@dataclass(frozen=True)
class RecordType:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    relationships: tuple[Relationship, ...] = ()
    enums: tuple[tuple[str, tuple[str, ...]], ...] = ()
    transient: tuple[str, ...] = ()
    tenant: tuple[str, ...] = ()

    def __post_init__(self):
        for name in (*self.key, *self.tenant):
            field_type(self.schema, name)


class Catalog:
    """Record types and their indexes, checked against the schemas."""

    def __init__(self, types: list[RecordType], indexes: dict[str, list[Index]] | None = None, version: tuple[int, int, int] = (1, 0, 0), former: tuple[str, ...] = ()):
        self.types = {t.name: t for t in types}
        self.indexes = {name: {i.name: i for i in (indexes or {}).get(name, [])} for name in self.types}
        self.version, self.former = version, former
        for name, own in self.indexes.items():
            for index in own.values():
                if index.name in former:
                    raise ValueError(f"{index.name} is a former index's name")
                for f in (*index.fields, *index.covering):
                    field_type(self.types[name].schema, f)

    def store(self, df: DataFrame, name: str, tenant: dict[str, Any] | None = None) -> Store:
        """Records of a type; a type with tenant fields needs a tenant, whose rows alone are seen."""
        kind = self.types[name]
        if set(kind.tenant) != set(tenant or {}):
            raise ValueError(f"{name} needs a tenant by {kind.tenant}")
        for f, v in (tenant or {}).items():
            df = df.where(F.col(f) == F.lit(v))
        return Store(df, kind, self.indexes[name])


def key_of(*parts: str | Column) -> Column:
    """Key expression: fields (nested ones with dots) and literals, as one struct."""
    return F.struct(*[F.col(p).alias(p.replace(".", "_")) if isinstance(p, str) else p for p in parts])


class Store:
    """Records of one type."""

    def __init__(self, df: DataFrame, kind: RecordType, indexes: dict[str, Index] | None = None):
        self.df, self.kind, self.indexes = df, kind, indexes or {}

    def query(self) -> Query:
        return Query(self.df, self.kind.key)

    def query_dsl(self, *clauses) -> Query:
        return from_clauses(self.query(), *clauses)

    def scan(self) -> DataFrame:
        return self.df

    def get(self, *key: Any) -> Row | None:
        """Record by its whole primary key."""
        return self.at(*key).first()

    def at(self, *key: Any) -> DataFrame:
        if len(key) != len(self.kind.key):
            raise ValueError(f"the key is {self.kind.key}")
        df = self.df
        for name, v in zip(self.kind.key, key, strict=True):
            df = df.where(F.col(name) == F.lit(v))
        return df

    def rank(self, score: str, group: list[str] | None = None, order: str = "desc") -> Leaderboard:
        return Leaderboard(self.df, score, list(self.kind.key), group, order)

    def aggregate(self, fn: aggregates.Aggregate, at: dict[str, Any] | None = None) -> Any:
        return aggregates.lookup(self.df, fn, at)

    def group_by(self, *fields: str) -> aggregates.Grouped:
        return aggregates.Grouped(self.df, list(fields))

    def permuted(self, index: str) -> DataFrame:
        """Rows in another order of an index's fields."""
        return self.df.orderBy(*self.indexes[index].fields, *self.kind.key)

    # ---- changes: every one gives a new store, nothing is written until the caller does

    def upsert(self, records: DataFrame) -> Store:
        """Store with records put in; of those that share a key the greatest by all fields stays."""
        new = records.select(*self.df.columns)
        self.check_dimensions(new)
        new = new.groupBy(*self.kind.key).agg(F.max_by(F.struct(*new.columns), F.struct(*orderable(new, new.columns))).alias("_r")).select("_r.*")
        kept = self.df.join(new.select(*self.kind.key), list(self.kind.key), "left_anti")
        return Store(kept.unionByName(new), self.kind, self.indexes)

    def check_dimensions(self, records: DataFrame) -> None:
        """Raise if a vector has another length than its index names in the option ``dimensions``; one aggregate."""
        wanted = {i.fields[0]: dict(i.options)["dimensions"] for i in self.indexes.values() if i.kind == "vector" and "dimensions" in dict(i.options)}
        if wanted:
            wrong = records.agg(*[F.count_if(F.size(f) != n).alias(f) for f, n in wanted.items()]).first()
            for f, n in wanted.items():
                if wrong[f]:
                    raise ValueError(f"{wrong[f]} vectors in {f} have not {n} dimensions")

    def violations(self, index: str) -> DataFrame:
        """Values of a unique index that several records share, with their number; nulls are no values."""
        fields = self.indexes[index].fields
        rows = self.df.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields]).dropna()
        return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).where("n > 1")

    def delete(self, keys: DataFrame) -> Store:
        return Store(self.df.join(keys.select(*self.kind.key).distinct(), list(self.kind.key), "left_anti"), self.kind, self.indexes)

    def delete_all(self) -> Store:
        return Store(self.df.where(F.lit(False)), self.kind, self.indexes)

    def related(self, name: str, others: DataFrame, how: str = "inner", where: Column | None = None) -> DataFrame:
        """Join along a declared relationship, in any of Spark's modes (outer, semi and anti ones too); ``where`` adds a condition between the sides, l and r."""
        relation = next(r for r in self.kind.relationships if r.name == name)
        left, right = self.df.alias("l"), others.alias("r")
        condition = None
        for a, b in relation.on:
            test = F.col(f"l.{a}") == F.col(f"r.{b}")
            condition = test if condition is None else condition & test
        return left.join(right, condition if where is None else condition & where, how)


class Context:
    """A unit of work: staged inserts, updates and deletes, applied together or dropped."""

    def __init__(self, store: Store):
        self.store, self.staged = store, []

    def save(self, records: DataFrame) -> None:
        self.staged.append(("save", records))

    def delete(self, keys: DataFrame) -> None:
        self.staged.append(("delete", keys))

    def rollback(self) -> None:
        self.staged = []

    def commit(self) -> Store:
        """The store after all staged changes, in their order."""
        for how, df in self.staged:
            self.store = self.store.upsert(df) if how == "save" else self.store.delete(df)
        self.staged = []
        return self.store
