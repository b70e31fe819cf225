"""Query plans: immutable descriptions that operators compile to DataFrames."""

from . import adapters
from .plan import ColumnClause, FieldClause, GroupClause, JoinLeg, OrderKey, Plan

__all__ = ["adapters", "ColumnClause", "FieldClause", "GroupClause", "JoinLeg", "OrderKey", "Plan"]
