"""Metadata filters: a small expression tree that becomes one two-valued Column.

Field names are matched without regard to case. Strings compare without regard to
ASCII case; floats within 1e-6 and doubles within 1e-12; ordered comparisons of
strings and booleans are false. A missing field (an absent column or a null) makes
a leaf false, except for ne, which it makes true. No children: and_ is true, or_
is false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How far apart equal floating-point numbers may be.
TOLERANCE = {T.FloatType: 1e-6, T.DoubleType: 1e-12}


@dataclass(frozen=True)
class Filter:
    op: str
    field: str | None = None
    value: object = None
    children: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        return and_(self, other)

    def __or__(self, other: Filter) -> Filter:
        return or_(self, other)

    def __invert__(self) -> Filter:
        return not_(self)


def eq(name, value): return Filter("eq", name, value)  # noqa: E704
def ne(name, value): return Filter("ne", name, value)  # noqa: E704
def gt(name, value): return Filter("gt", name, value)  # noqa: E704
def ge(name, value): return Filter("ge", name, value)  # noqa: E704
def lt(name, value): return Filter("lt", name, value)  # noqa: E704
def le(name, value): return Filter("le", name, value)  # noqa: E704
def in_(name, values): return Filter("in", name, tuple(values))  # noqa: E704
def not_in(name, values): return Filter("not_in", name, tuple(values))  # noqa: E704
def like(name, pattern): return Filter("like", name, pattern)  # noqa: E704
def regex(name, pattern): return Filter("regex", name, pattern)  # noqa: E704
def and_(*children): return Filter("and", children=children)  # noqa: E704
def or_(*children): return Filter("or", children=children)  # noqa: E704
def not_(child): return Filter("not", children=(child,))  # noqa: E704


def _leaf(f: Filter, schema: T.StructType) -> Column:
    named = next((s for s in schema if s.name.lower() == f.field.lower()), None)
    if named is None:
        return F.lit(f.op == "ne")
    c, kind = F.col(f"`{named.name}`"), named.dataType
    string = isinstance(kind, T.StringType)
    if f.op in ("in", "not_in"):
        found = F.lower(c).isin([str(v).lower() for v in f.value]) if string else c.isin(list(f.value))
        test = found if f.op == "in" else ~found
    elif f.op == "like":
        test = c.like(f.value)
    elif f.op == "regex":
        test = c.rlike(f.value)
    elif f.op in ("eq", "ne"):
        value = F.lit(f.value)
        if string:
            same = F.lower(c) == F.lower(value.cast("string"))
        elif type(kind) in TOLERANCE:
            same = F.abs(c - value.cast(kind)) <= TOLERANCE[type(kind)]
        else:
            same = c == value
        test = same if f.op == "eq" else ~same
    elif string or isinstance(kind, T.BooleanType):
        return F.lit(False)
    else:
        test = {"gt": c > f.value, "ge": c >= f.value, "lt": c < f.value, "le": c <= f.value}[f.op]
    return F.coalesce(test, F.lit(f.op == "ne"))


def to_column(f: Filter | Column | None, schema: T.StructType) -> Column:
    if f is None:
        return F.lit(True)
    if isinstance(f, Column):
        return F.coalesce(f, F.lit(False))
    if f.field is not None:
        return _leaf(f, schema)
    children = [to_column(c, schema) for c in f.children]
    if f.op == "not":
        return ~children[0]
    out = F.lit(f.op == "and")
    for c in children:
        out = out & c if f.op == "and" else out | c
    return out


def matching(df: DataFrame, f: Filter | Column | None) -> DataFrame:
    return df if f is None else df.filter(to_column(f, df.schema))
