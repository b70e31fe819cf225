"""The plan of a query: clauses, order, page and joins, in the order in which they take effect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class FieldClause:
    path: str
    op: str
    value: Any

    def to_dict(self) -> dict:
        return {"type": "field", "field": self.path, "op": self.op, "value": self.value}


@dataclass(frozen=True)
class ColumnClause:
    """An opaque predicate: a function from the DataFrame to a boolean Column."""

    build: Callable[[DataFrame], Column]

    def to_dict(self) -> dict:
        return {"type": "filter", "fn": "[function]"}


@dataclass(frozen=True)
class GroupClause:
    """Clauses joined by `or` or `and`; an empty `or` is false, an empty `and` is true."""

    how: str
    clauses: tuple

    def to_dict(self) -> dict:
        return {"type": "group", "op": self.how, "clauses": [c.to_dict() for c in self.clauses]}


@dataclass(frozen=True)
class OrderKey:
    path: str
    descending: bool = False

    def to_dict(self) -> dict:
        return {"field": self.path, "direction": "desc" if self.descending else "asc"}


@dataclass(frozen=True)
class JoinLeg:
    path: str
    alias: str
    target: str
    mode: str = "warn"
    strategy: str | None = None
    max_rows: int | str | None = None
    dictionary: bool = False

    def to_dict(self) -> dict:
        return {"field": self.path, "as": self.alias, "target": self.target, "mode": self.mode, "strategy": self.strategy, "maxRows": self.max_rows, "dictionary": self.dictionary}


@dataclass(frozen=True)
class Plan:
    clauses: tuple = ()
    order: tuple[OrderKey, ...] = ()
    limit: int | None = None
    offset: int = 0
    joins: tuple[JoinLeg, ...] = field(default=())

    def adding(self, **parts) -> Plan:
        """A plan with clauses, order keys or joins appended, and limit and offset replaced."""
        merged = {k: getattr(self, k) + v if isinstance(v, tuple) else v for k, v in parts.items()}
        return replace(self, **merged)

    def to_dict(self) -> dict:
        return {
            "clauses": [c.to_dict() for c in self.clauses], "orderBy": [o.to_dict() for o in self.order],
            "limit": self.limit, "offset": self.offset, "joins": [j.to_dict() for j in self.joins],
        }
