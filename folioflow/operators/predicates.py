"""Predicates compiled to filter Columns.

A clause never raises for a type that does not fit: a comparison with a missing, null or mismatched value does not hold,
and its negation does. In a filter null is as good as false, also under `or` and `and`, so that only negations are made
two-valued there, and bare comparisons, chosen with the schema in hand, reach the scan as pushed filters.
"""

from __future__ import annotations

import datetime
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ColumnClause, FieldClause, GroupClause

COMPARABLE = {"number", "string", "date"}


def kind_of_type(t: T.DataType | None) -> str:
    """number, string, date, boolean, array, struct, map, or other."""
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    for cls, name in ((T.BooleanType, "boolean"), (T.ArrayType, "array"), (T.StructType, "struct"), (T.MapType, "map")):
        if isinstance(t, cls):
            return name
    return "other"


def kind_of_value(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return "date"
    return "null" if v is None else "other"


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a dotted path; None where a segment is missing."""
    at: T.DataType | None = schema
    for part in path.split("."):
        if isinstance(at, T.StructType):
            at = at[part].dataType if part in at.names else None
        elif isinstance(at, T.MapType):
            at = at.valueType
        elif isinstance(at, T.ArrayType) and part.isdigit():
            at = at.elementType
        else:
            return None
    return at


def column_at(schema: T.StructType, path: str) -> Column:
    """Column of a dotted path; numeric segments address arrays, missing segments give NULL."""
    if type_at(schema, path) is None:
        return F.lit(None)
    first, *rest = path.split(".")
    at, column = schema[first].dataType, F.col(f"`{first}`")
    for part in rest:
        if isinstance(at, T.StructType):
            at, column = at[part].dataType, column.getField(part)
        elif isinstance(at, T.MapType):
            at, column = at.valueType, F.try_element_at(column, F.lit(part))
        else:
            at, column = at.elementType, F.get(column, F.lit(int(part)))
    return column


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _is_nan(v) -> bool:
    return isinstance(v, float) and math.isnan(v)


def _equal(column: Column, kind: str, value) -> Column:
    """Strict equality: same kind and same value; null equals null, NaN nothing."""
    other = kind_of_value(value)
    if other == "null":
        return column.isNull()
    if kind != other or _is_nan(value):
        return F.lit(False)
    return column.eqNullSafe(F.lit(value))


def _compare(column: Column, t: T.DataType | None, op: str, value) -> Column:
    kind = kind_of_type(t)
    if kind != kind_of_value(value) or kind not in COMPARABLE or _is_nan(value):
        return F.lit(False)
    v = F.lit(value)
    found = {"<": column < v, "<=": column <= v, ">": column > v, ">=": column >= v}[op]
    if isinstance(t, (T.DoubleType, T.FloatType)) and op in (">", ">="):
        found = found & ~F.isnan(column)
    return found


def _member(column: Column, t: T.DataType | None, values) -> Column:
    if not isinstance(values, (list, tuple, set, frozenset)):
        return F.lit(False)
    kind = kind_of_type(t)
    fit = [v for v in values if kind_of_value(v) == kind and not _is_nan(v)]
    found = [column.isin(*fit)] if fit else []
    if any(v is None for v in values):
        found.append(column.isNull())
    if any(_is_nan(v) for v in values) and isinstance(t, (T.DoubleType, T.FloatType)):
        found.append(F.isnan(column))
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def _contains(column: Column, t: T.DataType | None, value) -> Column:
    if kind_of_type(t) == "string" and isinstance(value, str):
        return column.contains(value)
    if isinstance(t, T.ArrayType):
        if value is None:
            return F.exists(column, lambda x: x.isNull())
        if kind_of_type(t.elementType) == kind_of_value(value):
            return F.exists(column, lambda x: x.eqNullSafe(F.lit(value)))
    return F.lit(False)


def compile_field(schema: T.StructType, clause: FieldClause) -> Column:
    t = type_at(schema, clause.path)
    column, kind, value, op = column_at(schema, clause.path), kind_of_type(t), clause.value, clause.op
    if op == "==":
        return _equal(column, kind, value)
    if op == "!=":
        return ~_equal(column, kind, value)
    if op in ("<", "<=", ">", ">="):
        return _compare(column, t, op, value)
    if op == "in":
        return _member(column, t, value)
    if op == "contains":
        return _contains(column, t, value)
    if op == "startsWith":
        return column.startswith(value) if kind == "string" and isinstance(value, str) else F.lit(False)
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            return F.lit(False)
        return _compare(column, t, ">=", value[0]) & _compare(column, t, "<=", value[1])
    # beyond parity: documented extras
    if op == "not-in":
        return ~F.coalesce(_member(column, t, value), F.lit(False))
    if op == "array-contains-any":
        any_of = [_contains(column, t, v) for v in value] if isinstance(t, T.ArrayType) else []
        return reduce(lambda a, b: a | b, any_of, F.lit(False))
    raise ValueError(f"unknown operator {op!r}")


def compile_clause(df: DataFrame, clause) -> Column:
    """A clause as a two-valued Column, for any use."""
    return F.coalesce(filter_column(df, clause), F.lit(False))


def filter_column(df: DataFrame, clause) -> Column:
    """A clause as a Column for a filter, which takes null as false."""
    if isinstance(clause, FieldClause):
        return compile_field(df.schema, clause)
    if isinstance(clause, ColumnClause):
        return clause.build(df)
    if isinstance(clause, GroupClause):
        parts = [filter_column(df, c) for c in clause.clauses]
        if not parts:
            return F.lit(clause.how != "or")
        return reduce((lambda a, b: a | b) if clause.how == "or" else (lambda a, b: a & b), parts)
    raise TypeError(f"not a clause: {clause!r}")


def apply_clauses(df: DataFrame, clauses) -> DataFrame:
    for clause in clauses:
        df = df.where(filter_column(df, clause))
    return df
