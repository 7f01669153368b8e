"""Document filters as values that compile to Spark columns.

A filter is a tree of `Eq`, `Exists`, `Any_` (or), `All` (and) and `ElemMatch`; `condition` turns it
into one boolean column, so it is pushed to the scan like any other predicate.

Rules: paths are dotted and may cross structs and arrays; equality on an array field holds when any
element equals; several values mean "one of"; no value at all adds no condition; an absent field is
NULL.  What an empty filter means is the caller's contract: `store.find_all` gives no row,
`store.find_cursor` raises, `store.count` counts everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Eq:
    field: str
    value: object


@dataclass(frozen=True)
class Exists:
    field: str
    present: bool = True


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class ElemMatch:
    """Some element of the array field satisfies the whole inner filter."""

    field: str
    inner: object


@dataclass(frozen=True)
class Projection:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


Filter = Eq | Exists | Any_ | All | ElemMatch


def any_of(*parts: Filter) -> Any_:
    return Any_(parts)


def all_of(*parts: Filter) -> All:
    return All(parts)


def _type_at(schema: T.DataType, path: Sequence[str]) -> T.DataType:
    """Type of a dotted path; once an array is crossed the result is an array."""
    in_array = False
    for name in path:
        while isinstance(schema, T.ArrayType):
            schema, in_array = schema.elementType, True
        schema = schema[name].dataType
    return T.ArrayType(schema) if in_array else schema


def _reach(root, path: str) -> Column:
    return reduce(lambda c, name: c[name], path.split("."), root) if isinstance(root, Column) else F.col(path)


def _compile(q: Filter, schema: T.DataType, root=None) -> Column | None:
    if isinstance(q, Eq):
        values = list(q.value) if isinstance(q.value, (list, tuple, set, frozenset)) else [q.value]
        if not values:
            return None
        at = _reach(root, q.field)
        if isinstance(_type_at(schema, q.field.split(".")), T.ArrayType):
            hit = F.array_contains(at, values[0]) if len(values) == 1 else F.arrays_overlap(at, F.array(*map(F.lit, values)))
            return F.coalesce(hit, F.lit(False))
        return at == F.lit(values[0]) if len(values) == 1 else at.isin(values)
    if isinstance(q, Exists):
        at = _reach(root, q.field)
        return at.isNotNull() if q.present else at.isNull()
    if isinstance(q, ElemMatch):
        kind = _type_at(schema, q.field.split("."))
        if not isinstance(kind, T.ArrayType):
            raise TypeError(f"{q.field} is not an array")
        return F.exists(_reach(root, q.field), lambda e: F.coalesce(_required(_compile(q.inner, kind.elementType, e)), F.lit(False)))
    if isinstance(q, (Any_, All)):
        parts = [c for c in (_compile(p, schema, root) for p in q.parts) if c is not None]
        if not parts:
            return None
        return reduce((lambda a, b: a | b) if isinstance(q, Any_) else (lambda a, b: a & b), parts)
    raise TypeError(f"not a filter: {q!r}")


def _required(c: Column | None) -> Column:
    return F.lit(True) if c is None else c


def condition(q: Filter | None, df: DataFrame) -> Column | None:
    """The filter as a column of `df`, or None if it holds no condition."""
    return None if q is None else _compile(q, df.schema)


def project(df: DataFrame, p: Projection | None) -> DataFrame:
    """Include lists keep `_id` where there is one, unless it is excluded."""
    if p is None:
        return df
    if p.include:
        keep = [c for c in df.columns if (c in p.include or c == "_id") and c not in p.exclude]
        return df.select(*keep)
    return df.drop(*p.exclude)
