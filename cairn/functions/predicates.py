"""Predicates with two-valued logic over optional and multi-valued fields.

``field("age") >= 30`` builds a tree; ``compiled`` turns it into a Column. A
comparison with an absent value is false and its negation true; on an array
field a comparison holds if any element satisfies it. NOT is pushed to the
leaves, so that plain comparisons reach the Parquet scan as they are.
"""

from __future__ import annotations

import datetime
import decimal
import operator
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_OPPOSITE = {"==": "!=", "!=": "==", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Both("and", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Both("or", (self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def fields(self) -> set[str]:
        raise NotImplementedError

    def column(self, schema: T.StructType, negated: bool) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Both(Predicate):
    how: str
    parts: tuple[Predicate, ...]

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.parts))

    def column(self, schema: T.StructType, negated: bool) -> Column:
        join = operator.and_ if (self.how == "and") != negated else operator.or_
        out = self.parts[0].column(schema, negated)
        for p in self.parts[1:]:
            out = join(out, p.column(schema, negated))
        return out


@dataclass(frozen=True, eq=False)
class Not(Predicate):
    part: Predicate

    def fields(self) -> set[str]:
        return self.part.fields()

    def column(self, schema: T.StructType, negated: bool) -> Column:
        return self.part.column(schema, not negated)


@dataclass(frozen=True, eq=False)
class Opaque(Predicate):
    """A Column of the user's; null counts as false."""

    condition: Column
    uses: frozenset[str] = frozenset()

    def fields(self) -> set[str]:
        return set(self.uses)

    def column(self, schema: T.StructType, negated: bool) -> Column:
        return ~F.coalesce(self.condition, F.lit(False)) if negated else self.condition


@dataclass(frozen=True, eq=False)
class Leaf(Predicate):
    name: str
    op: str
    value: Any

    def fields(self) -> set[str]:
        return {self.name}

    def column(self, schema: T.StructType, negated: bool) -> Column:
        kind = field_type(schema, self.name)
        col = F.col(self.name)
        if isinstance(kind, T.ArrayType):
            self.check(kind.elementType)
            if self.op == "in":
                found = F.arrays_overlap(col, F.array(*[F.lit(v).cast(kind.elementType) for v in self.value])) if self.value else F.lit(False)
            else:
                found = F.exists(col, self.test)
            return ~F.coalesce(found, F.lit(False)) if negated else found
        self.check(kind)
        if not negated:
            return self.test(col)
        if self.op in _OPPOSITE:
            return _COMPARE[_OPPOSITE[self.op]](col, F.lit(self.value)) | col.isNull()
        return ~self.test(col) | col.isNull()

    def test(self, col: Column) -> Column:
        if self.op == "in":
            return col.isin(*self.value) if self.value else F.lit(False)
        if self.op == "prefix":
            return col.startswith(self.value)
        if self.op == "contains":
            return col.contains(self.value)
        return _COMPARE[self.op](col, F.lit(self.value))

    def check(self, kind: T.DataType) -> None:
        """Values of another kind than the field's are an error, not a silent false."""
        for v in self.value if self.op == "in" else (self.value,):
            good = (
                isinstance(v, bool) if isinstance(kind, T.BooleanType)
                else isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) if isinstance(kind, T.NumericType)
                else isinstance(v, str) if isinstance(kind, T.StringType)
                else isinstance(v, (datetime.date, str)) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
                else isinstance(v, (bytes, bytearray)) if isinstance(kind, T.BinaryType)
                else False
            )
            if not good or self.op in ("prefix", "contains") and not isinstance(kind, T.StringType):
                raise TypeError(f"{self.name} is {kind.simpleString()}; {self.op} {v!r} does not fit")


class Field:
    """A field by name; nested names have dots."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, v: Any) -> Predicate:  # type: ignore[override]
        return Leaf(self.name, "==", v)

    def __ne__(self, v: Any) -> Predicate:  # type: ignore[override]
        return Leaf(self.name, "!=", v)

    def __lt__(self, v: Any) -> Predicate:
        return Leaf(self.name, "<", v)

    def __le__(self, v: Any) -> Predicate:
        return Leaf(self.name, "<=", v)

    def __gt__(self, v: Any) -> Predicate:
        return Leaf(self.name, ">", v)

    def __ge__(self, v: Any) -> Predicate:
        return Leaf(self.name, ">=", v)

    __hash__ = None  # type: ignore[assignment]

    def is_in(self, values: Iterable[Any]) -> Predicate:
        return Leaf(self.name, "in", tuple(values))

    def has_prefix(self, text: str) -> Predicate:
        return Leaf(self.name, "prefix", text)

    def contains(self, text: str) -> Predicate:
        return Leaf(self.name, "contains", text)


def field(name: str) -> Field:
    return Field(name)


def field_type(schema: T.StructType, name: str) -> T.DataType:
    kind: T.DataType = schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise KeyError(f"no field {name}")
        kind = kind[part].dataType
    return kind


def compiled(p: Predicate, schema: T.StructType) -> Column:
    return p.column(schema, False)
