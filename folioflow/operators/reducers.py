"""Reducers: count, sum, avg, min, max with the numeric reading of the engine, and custom ones.

A field that is not a finite number reads as 0, for every reducer: avg divides by the rows, min and max see the zeros. Over
no rows sum is 0, count 0, and avg, min and max are null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import column_at, fresh, kind_of_type, type_at

MAX_GROUPS = 100_000


@dataclass(frozen=True)
class Reducer:
    kind: str
    path: str | None = None
    build: Callable[[DataFrame], Column] | None = None

    def column(self, df: DataFrame) -> Column:
        if self.build is not None:
            return self.build(df)
        if self.kind == "count":
            return F.count(F.lit(1))
        n = numeric(df.schema, self.path)
        return {"sum": F.coalesce(F.sum(n), F.lit(0.0)), "avg": F.avg(n), "min": F.min(n), "max": F.max(n)}[self.kind]


def numeric(schema: T.StructType, path: str) -> Column:
    """A field as a finite double, anything else as 0."""
    t = type_at(schema, path)
    if kind_of_type(t) != "number":
        return F.lit(0.0)
    column = column_at(schema, path).cast("double")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf")), column).otherwise(0.0)
    return F.coalesce(column, F.lit(0.0))


def count(seed=None) -> Reducer:
    return Reducer("count")


def sum_of(path: str, seed=None) -> Reducer:
    return Reducer("sum", path)


def avg(path: str, seed=None) -> Reducer:
    return Reducer("avg", path)


def least(path: str, seed=None) -> Reducer:
    return Reducer("min", path)


def greatest(path: str, seed=None) -> Reducer:
    return Reducer("max", path)


def custom(build: Callable[[DataFrame], Column]) -> Reducer:
    """Any aggregate Column of the filtered frame."""
    return Reducer("custom", build=build)


def reduce_rows(df: DataFrame, spec: dict[str, Reducer]) -> DataFrame:
    """One row of named reducers."""
    return df.agg(*[r.column(df).alias(name) for name, r in spec.items()])


def at_most(df: DataFrame, ceiling: int | None, what: str) -> DataFrame:
    """df, which fails when it runs if it has more rows than the ceiling; the check is a part of its plan, not a job."""
    if ceiling is None:
        return df
    n = df.limit(ceiling + 1).agg(F.count(F.lit(1)).alias("n")).scalar()  # stops as soon as the ceiling is passed
    return df.where(F.when(n > ceiling, F.raise_error(F.lit(f"RowCeiling: more than {ceiling} {what}")).cast("boolean")).otherwise(True))


def group_rows(df: DataFrame, path: str, spec: dict[str, Reducer], seq: str | None = None, max_groups: int | None = MAX_GROUPS) -> DataFrame:
    """One row a key, named as the last segment of the path, in the order keys were first seen if seq orders rows.

    Partial aggregates run before the shuffle, so that a hot key moves a row a task. The ceiling is checked by the plan
    itself, over the shuffle that the groups use too; None leaves it out.
    """
    name = path if "." not in path else path.split(".")[-1]
    grouped = df.groupBy(column_at(df.schema, path).alias(name))
    first = fresh(df, "_first")
    order = [F.min(seq).alias(first)] if seq else []
    out = at_most(grouped.agg(*[r.column(df).alias(n) for n, r in spec.items()], *order), max_groups, f"groups of {path!r}")
    return out.orderBy(first).drop(first) if seq else out
