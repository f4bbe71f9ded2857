"""Schema evolution: which changes are safe, and migrations between versions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.catalog import Catalog, Index

_WIDER = {("byte", "short"), ("byte", "integer"), ("byte", "long"), ("short", "integer"), ("short", "long"), ("integer", "long"), ("float", "double")}


def evolution_errors(old: Catalog, new: Catalog) -> list[str]:
    """What keeps data written under ``old`` from being read under ``new``; empty if nothing does."""
    out = []
    for name, was in old.types.items():
        now = new.types.get(name)
        if now is None:
            out.append(f"type {name} was removed")
            continue
        if was.key != now.key:
            out.append(f"{name}: the primary key changed")
        for f in was.schema.fields:
            if f.name not in now.schema.names:
                out.append(f"{name}.{f.name} was removed")
                continue
            g = now.schema[f.name]
            if f.dataType != g.dataType and (f.dataType.typeName(), g.dataType.typeName()) not in _WIDER:
                out.append(f"{name}.{f.name} changed from {f.dataType.simpleString()} to {g.dataType.simpleString()}")
            if f.nullable and not g.nullable:
                out.append(f"{name}.{f.name} became required")
        for g in now.schema.fields:
            if g.name not in was.schema.names and not g.nullable and "default" not in g.metadata:
                out.append(f"{name}.{g.name} is new, required and has no default")
        enums = dict(now.enums)
        for f, values in was.enums:
            if gone := sorted(set(values) - set(enums.get(f, values))):
                out.append(f"{name}.{f} lost {gone}")
        for i, index in old.indexes[name].items():
            if i not in new.indexes[name] and i not in new.former:
                out.append(f"index {i} was removed without being kept as a former index")
            elif i in new.indexes[name] and (index.kind, index.fields) != (new.indexes[name][i].kind, new.indexes[name][i].fields):
                out.append(f"index {i} changed its form")
    return out


def evolved(df: DataFrame, to: T.StructType) -> DataFrame:
    """df under a later schema: fields widened, new ones with their default (metadata ``default``) or null."""
    columns: list[Column] = []
    for f in to.fields:
        default = F.lit(f.metadata.get("default")).cast(f.dataType)
        columns.append((F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in df.columns else default).alias(f.name))
    return df.select(*columns)


def allowed(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Rows whose enum field holds a value that isn't allowed."""
    return df.where(F.col(name).isNotNull() & ~F.col(name).isin(*values))


@dataclass(frozen=True)
class Step:
    """One operation on a type's rows or indexes."""

    kind: str
    type: str
    what: Any


def add_index(type: str, index: Index) -> Step:
    return Step("add_index", type, index)


def remove_index(type: str, name: str) -> Step:
    return Step("remove_index", type, name)


def rebuild_index(type: str, name: str) -> Step:
    return Step("rebuild_index", type, name)


def transform(type: str, f: Callable[[DataFrame], DataFrame]) -> Step:
    return Step("transform", type, f)


def delete_where(type: str, condition: Column) -> Step:
    return Step("delete", type, condition)


def execute(type: str, f: Callable[[DataFrame], DataFrame]) -> Step:
    return Step("transform", type, f)


@dataclass(frozen=True)
class Migration:
    since: tuple[int, int, int]
    to: tuple[int, int, int]
    steps: tuple[Step, ...] = field(default=())


def path(migrations: list[Migration], since: tuple[int, int, int], to: tuple[int, int, int]) -> list[Migration]:
    """Fewest migrations from one version to another; raises if there is no way."""
    ways: dict[tuple[int, int, int], list[Migration]] = {since: []}
    for at in (queue := [since]):
        for m in migrations:
            if m.since == at and m.to not in ways:
                ways[m.to] = [*ways[at], m]
                queue.append(m.to)
    if to not in ways:
        raise LookupError(f"no migrations from {since} to {to}")
    return ways[to]


@dataclass
class State:
    """Tables and index sets as migrations leave them; ``rebuild`` names indexes whose tables must be written anew."""

    tables: dict[str, DataFrame]
    indexes: dict[str, dict[str, Index]]
    version: tuple[int, int, int]
    former: tuple[str, ...] = ()
    rebuild: tuple[str, ...] = ()


def migrate(state: State, migrations: list[Migration], to: tuple[int, int, int]) -> State:
    """Apply the way to a version; tables stay lazy, so a chain of row changes is one plan."""
    tables, indexes = dict(state.tables), {k: dict(v) for k, v in state.indexes.items()}
    former, rebuild = list(state.former), list(state.rebuild)
    for m in path(migrations, state.version, to):
        for s in m.steps:
            own = indexes.setdefault(s.type, {})
            if s.kind == "add_index":
                own[s.what.name] = s.what
                rebuild.append(s.what.name)
            elif s.kind == "remove_index":
                own.pop(s.what)
                former.append(s.what)
            elif s.kind == "rebuild_index":
                rebuild.append(own[s.what].name)
            elif s.kind == "delete":
                tables[s.type] = tables[s.type].where(~F.coalesce(s.what, F.lit(False)))
                rebuild += own
            else:
                tables[s.type] = s.what(tables[s.type])
                rebuild += own
    return State(tables, indexes, to, tuple(former), tuple(dict.fromkeys(n for n in rebuild if any(n in v for v in indexes.values()))))


def lightweight(old: Catalog, new: Catalog) -> Migration:
    """Migration for changes that need no code: new fields and new indexes. Others raise."""
    if errors := evolution_errors(old, new):
        raise ValueError("; ".join(errors))
    steps = []
    for name, now in new.types.items():
        if name in old.types:
            if now.schema != old.types[name].schema:
                steps.append(transform(name, lambda df, to=now.schema: evolved(df, to)))
            steps += [add_index(name, i) for k, i in new.indexes[name].items() if k not in old.indexes[name]]
            steps += [remove_index(name, k) for k in old.indexes[name] if k not in new.indexes[name]]
    return Migration(old.version, new.version, tuple(steps))
